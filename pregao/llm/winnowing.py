"""Document fingerprints by winnowing.

A text is lower-cased and cut into words. Every run of ``gram`` words has a rolling
hash (a polynomial in the word hashes modulo a prime), and of each ``window``
neighbouring grams the smallest hash is kept, the rightmost one where several tie,
together with its position. Two texts that share a run of ``gram + window - 1`` words
are guaranteed to share a kept hash.

Defined results: null counts as the empty text, whose fingerprint is that of one empty
word; a text with fewer words than a gram is one gram, and one with fewer grams than
a window is one window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pregao.llm.common import BLANK_CHARS, BLANKS, let

GRAM = 5
WINDOW = 4
PRIME = (1 << 31) - 1
BASE = 1_000_003


def _at(array: Column, i: Column, step: int) -> Column:
    return F.get(array, i + F.lit(step) if step else i)


def _grams(words: Column, gram: int) -> Column:
    """Polynomial hash of every run of ``gram`` word hashes; of all words if they are fewer."""

    def poly(terms: list[Column]) -> Column:
        value = terms[0]
        for term in terms[1:]:
            value = (value * F.lit(BASE) + term) % F.lit(PRIME)
        return value

    whole = F.array(F.aggregate(words, F.lit(0).cast("long"), lambda a, w: (a * F.lit(BASE) + w) % F.lit(PRIME)))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - gram), lambda i: poly([_at(words, i, s) for s in range(gram)]))
    return F.when(F.size(words) < gram, whole).otherwise(runs)


def _minima(keys: Column, window: int) -> Column:
    """Smallest key of every ``window`` neighbours, each kept once."""
    every = F.transform(
        F.sequence(F.lit(0), F.size(keys) - window), lambda i: F.least(*[_at(keys, i, s) for s in range(window)])
    )
    return F.when(F.size(keys) < window, F.array(F.array_min(keys))).otherwise(F.array_distinct(every))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept grams in text order: an array of longs, ``hash << 32 | (2**32 - 1 - position)``.

    The smallest such number of a window is its smallest hash, at the rightmost position.
    """
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANK_CHARS))
    words = F.transform(F.split(trimmed, BLANKS), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    last = F.lit((1 << 32) - 1)
    keyed = let(
        words,
        lambda w: F.transform(_grams(w, gram), lambda h, i: F.shiftleft(h, 32).bitwiseOR(last - i)),
    )
    return let(keyed, lambda k: _minima(k, window))


def positions(kept: Column) -> Column:
    """The kept grams as (hash, position) pairs; a position is the gram's first word."""
    return F.transform(
        kept,
        lambda k: F.struct(
            F.shiftright(k, 32).alias("hash"),
            (F.lit((1 << 32) - 1) - k.bitwiseAND(F.lit((1 << 32) - 1))).alias("position"),
        ),
    )


def hashes(kept: Column) -> Column:
    """The set of kept hashes."""
    return F.array_distinct(F.transform(kept, lambda k: F.shiftright(k, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash sets, 0 to 1."""
    return let(
        F.size(F.array_intersect(a, b)), lambda both: (both / (F.size(a) + F.size(b) - both)).cast("double")
    )


def digest(kept: Column) -> Column:
    """Text form of a fingerprint: 128 bits over its hashes and positions."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), kept)), 16, "0") for seed in (1, 2)]))
