"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
that no neighbouring word extends. The words of many documents are laid out in one array
with a word of its own before each document, so that no run crosses a border, and
all steps work on the array:

1. Highly periodic regions, with periods up to ``DIRECT`` words, are found by comparing
   the array with itself shifted by each of those periods.
2. At each dyadic scale t every stretch of t words has a hash. Position i is selected if the
   least hash of the stretches that start in [i, i + t] is that at i or at i + t; stretches in
   highly periodic regions (period at most t / 3, known from step 1 and lower scales) take no
   part. Whether a position is selected depends on the 2 t words from it alone, so
   a run selects the same places in each of its periods.
3. Selected positions that follow one another with equal contexts propose their
   distance as a period: contexts of 2 t words for 1.5 t to 2 t, of 3 t words for 2 t to 3 t.
   Any run of three periods holds such a pair, as some t has its period in that range.
4. Proposals of one period that touch are merged and extended word by word to both sides.

All runs of three periods are found, which the next scale needs, and those long enough
are returned.

Defined results: null and empty texts and texts of blanks have no words and no runs; rows
are looked at one by one, so repeated rows have equal results; an empty table gives no rows;
names of other columns do not matter. The memory of a task grows with its longest text, by
about 150 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
DIRECT = 5  # longest period that step 1 looks for
FIRST_SCALE = 4  # whose proposals start at 6 words
SLICE_BYTES = 4_000_000  # text looked at together
NOTHING = np.uint64((1 << 64) - 1)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _ahead(values: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    """The value ``by`` places further on, ``fill`` past the end."""
    moved = np.full_like(values, fill)
    moved[: max(len(values) - by, 0)] = values[by:]
    return moved


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from their hashes."""
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _extended(words: np.ndarray, left: np.ndarray, right: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[left, right) of each proposal, whose words equal those a period on, made as wide as that holds."""
    left, right, last = left.copy(), right.copy(), len(words) - 1
    active, step = np.arange(len(left)), 16
    while len(active):
        at = np.maximum(left[active, None] - 1 - np.arange(step), 0)
        same = words[at] == words[at + period[active, None]]
        grown = np.where(same.all(axis=1), step, same.argmin(axis=1))
        left[active] -= grown
        active, step = active[grown == step], min(2 * step, 4096)
    active, step = np.arange(len(left)), 16
    while len(active):
        at = np.minimum(right[active, None] + period[active, None] + np.arange(step), last)
        same = words[at] == words[at - period[active, None]]
        grown = np.where(same.all(axis=1), step, same.argmin(axis=1))
        right[active] += grown
        active, step = active[grown == step], min(2 * step, 4096)
    return left, right


def _direct(words: np.ndarray, period: int) -> np.ndarray:
    """(start, end, period) of all stretches of three or more of a short period."""
    same = np.r_[False, words[:-period] == words[period:], False]
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= 2 * period]
    return np.column_stack([edges[:, 0], edges[:, 1] + period, np.full(len(edges), period)])


def _selected(ids: np.ndarray, scale: int, runs: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set; ``runs`` are the known ones, in places of this array."""
    regions = runs[(3 * runs[:, 2] <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    if len(regions):
        change = np.bincount(regions[:, 0], minlength=len(ids) + 1)
        change -= np.bincount(regions[:, 1] - scale + 1, minlength=len(ids) + 1)
        ids = np.where(np.cumsum(change)[: len(ids)] > 0, NOTHING, ids)
    least, width = ids, 1
    while width < scale:
        least, width = np.minimum(least, _ahead(least, width, NOTHING)), 2 * width
    least = np.minimum(least, _ahead(least, 1, NOTHING))
    return np.flatnonzero((least != NOTHING) & ((least == ids) | (least == _ahead(ids, scale, NOTHING))))


def _proposed(words: np.ndarray, places: np.ndarray, context: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """(start, end, period) of stretches of three periods, proposed by neighbouring places with equal context."""
    order = np.argsort(context, kind="stable")
    first, second = places[order[:-1]], places[order[1:]]
    period = second - first
    wanted = (context[order[:-1]] == context[order[1:]]) & (period >= low) & (period <= high)
    first, period = first[wanted], period[wanted]
    if not len(first):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((first, period))
    first, period = first[order], period[order]
    new = np.r_[True, (period[1:] != period[:-1]) | (first[1:] > first[:-1] + size)]
    heads = np.flatnonzero(new)
    left, right = first[heads], first[np.r_[heads[1:], len(first)] - 1] + size
    left, right = _extended(words, left, right, period[heads])
    found = np.column_stack([left, right + period[heads], period[heads]])
    return np.unique(found[right - left >= 2 * period[heads]], axis=0)


def find_runs(codes: np.ndarray, sizes: np.ndarray, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(text, start, length, period) of the runs of many texts, sorted; ``codes`` are their words one after another.

    A run has at least ``min_length`` words and ``min_exponent`` (3 or more) periods.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    # A word of its own before each text and after the last one.
    heads = np.cumsum(sizes + 1) - (sizes + 1)
    words = np.empty(len(codes) + len(sizes) + 1, np.int64)
    inner = np.ones(len(words), bool)
    inner[heads], inner[-1] = False, False
    words[inner], words[heads], words[-1] = codes, -1 - np.arange(len(sizes)), -1 - len(sizes)
    origin, texts = heads, np.arange(len(sizes))  # where the blocks that are left began
    found = [_direct(words, p) for p in range(1, min(DIRECT, len(words) - 1) + 1)]
    ids, scale = _mixed(words.astype(np.uint64)), 1
    while True:
        if scale >= FIRST_SCALE:
            # Texts too short for three periods of this scale are done.
            stays = 2 * sizes[texts] >= 9 * scale
            if not stays.any():
                break
            if not stays.all():
                block = np.r_[np.repeat(stays, sizes[texts] + 1), True]
                words, ids, texts = words[block], ids[block], texts[stays]
                origin = heads[texts]
            starts = np.cumsum(sizes[texts] + 1) - (sizes[texts] + 1)
            known = np.concatenate(found)
            home = np.searchsorted(origin, known[:, 0], "right") - 1
            here = home >= 0
            here[here] = known[here, 1] <= origin[home[here]] + sizes[texts[home[here]]] + 1
            known, home = known[here], home[here]
            moved = starts[home] - origin[home]
            known = known + np.column_stack([moved, moved, np.zeros_like(moved)])
            places = _selected(ids, scale, known)
            double = _joined(ids, _ahead(ids, scale))
            for context, size, low, high in (
                (double[places], 2 * scale, 3 * scale // 2, 2 * scale),
                (_joined(double, _ahead(ids, 2 * scale))[places], 3 * scale, 2 * scale, 3 * scale),
            ):
                runs = _proposed(words, places, context, size, low, high)
                home = np.searchsorted(starts, runs[:, 0], "right") - 1
                moved = origin[home] - starts[home]
                found.append(runs + np.column_stack([moved, moved, np.zeros_like(moved)]))
            ids = double
        else:
            ids = _joined(ids, _ahead(ids, scale))
        scale *= 2
    runs = np.concatenate(found)
    # A multiple of the smallest period has the same ends.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)][: len(runs)]]
    length = runs[:, 1] - runs[:, 0]
    runs = runs[(length >= min_length) & (length >= min_exponent * runs[:, 2])]
    home = np.searchsorted(heads, runs[:, 0], "right") - 1
    result = np.column_stack([home, runs[:, 0] - heads[home] - 1, runs[:, 1] - runs[:, 0], runs[:, 2]])
    return result[np.lexsort((result[:, 3], result[:, 1], result[:, 0]))]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, counts = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    # Blanks at either end of a text leave empty words.
    some = pc.greater(pc.binary_length(words), 0)
    row = np.repeat(np.arange(len(counts)), counts)[some.to_numpy(zero_copy_only=False)]
    return words.filter(some), np.bincount(row, minlength=len(counts))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _looked_at(texts: pa.Array, min_exponent: int, min_length: int) -> list[pa.Array]:
    words, counts = words_of(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(codes, counts, min_exponent, min_length)
    first = (np.cumsum(counts) - counts)[runs[:, 0]] + runs[:, 1]
    change = np.bincount(first + runs[:, 3], minlength=len(codes) + 1)
    change -= np.bincount(first + runs[:, 2], minlength=len(codes) + 1)
    kept = np.cumsum(change)[: len(codes)] == 0
    row = np.repeat(np.arange(len(counts)), counts)[kept]
    collapsed = pc.binary_join(_lists(words.filter(pa.array(kept)), np.bincount(row, minlength=len(counts))), " ")
    fields = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], fields=list(RUN))
    return [pa.array(counts.astype(np.int64)), _lists(fields, np.bincount(runs[:, 0], minlength=len(counts))), collapsed]


def _slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First row and rows of slices of about so many bytes."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, stop - at
        at = stop


def _run_batches(batches: Iterator[pa.RecordBatch], carry: list[str], min_exponent: int, min_length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, rows in _slices(batch.column("_looked_at")):
            part = batch.slice(at, rows)
            found = _looked_at(part.column("_looked_at"), min_exponent, min_length)
            yield pa.record_batch([*[part.column(c) for c in carry], *found], names=[*carry, "n_words", "runs", "collapsed"])


def periodic_runs(
    docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH
) -> DataFrame:
    """``carry`` columns, number of words, runs by start and period, and the text without repeats, per row.

    A repeat is a word that some run holds after its first period; the other words are
    joined by one space.
    """
    rows = docs.select(*carry, F.col(text).alias("_looked_at"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_looked_at")
    schema = f"{kept}, {RUNS_SCHEMA}" if kept else RUNS_SCHEMA
    return rows.mapInArrow(lambda batches: _run_batches(batches, list(carry), min_exponent, min_length), schema)
