"""Packing documents into fixed-length token sequences by length patterns.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut.
The packing is worked out on the histogram of piece lengths alone, so what the driver
handles is bounded by ``capacity`` whatever the corpus:

1. Lengths are put into ``BINS`` bins and every pattern of up to three bins that fills a
   sequence is listed.
2. Non-negative least squares fits how often each pattern is repeated, so that the
   patterns together use up the histogram. The repeats are rounded down.
3. Patterns draw exact lengths from their bins.
4. What is left, and the room left in the patterns, is packed best fit, longest first,
   many equal sequences at a time.

The pieces are then numbered in order of length, and a piece's number says which
sequence it goes to and where it lies there.

Defined results: a null or empty text is the end token alone; repeated rows are packed
as often as they occur; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import array
import bisect
import functools
import itertools
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregao.llm.common import numbered, released
from pregao.session import materialise

CAPACITY = 4096
END_TOKEN = 1
BINS = 256
SLICE_BYTES = 4_000_000  # text tokenized at once
KNOWN_PARTS = 400_000  # word parts whose ids a process remembers, about 100 MB


class WordTokenizer:
    """A tokenizer file, used as it is, with the ids of the word parts that were seen first.

    Ids do not depend on what is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings that the tokenizer looks for before it does anything else.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "(?i)" + "|".join(re.escape(a) for a in added) if added else None
        self.known: dict[str, bytes] = {}

    def ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part encoded alone, as 32-bit numbers one after another."""
        found = [self.known.get(p) for p in parts]
        new = [i for i, f in enumerate(found) if f is None]
        for i, e in zip(new, self.tokenizer.encode_batch_fast([parts[i] for i in new], add_special_tokens=False), strict=True):
            found[i] = array.array("I", e.ids).tobytes()
            if len(self.known) < KNOWN_PARTS:
                self.known[parts[i]] = found[i]
        return found


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once per process."""
    return WordTokenizer(path)


def _gather(ids: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``picks`` of a flat array of runs, and where each begins in the result (and it ends)."""
    starts, picked = np.cumsum(sizes) - sizes, sizes[picks]
    ends = np.r_[0, np.cumsum(picked)]
    return ids[np.repeat(starts[picks] - ends[:-1], picked) + np.arange(ends[-1])], ends


def _word_parts(words: pa.Array, added: str | None) -> pa.Array:
    """Each word as parts that are encoded alone: ASCII punctuation after a Latin letter, and the rest.

    The tokenizer cuts there anyway and lowers case anyway, so this only makes more words alike.
    (Some letters of other scripts normalise to a letter and a mark, which joins the punctuation.)
    Words with combining marks keep their case, since lowering it first may change how they compose.
    Words that hold an ``added`` string of the tokenizer, in any case, stay as they are.
    """
    plain = pc.invert(pc.match_substring_regex(words, r"\pM"))
    lowered = pc.if_else(plain, pc.ascii_lower(words), words)
    cut = pc.replace_substring_regex(lowered, r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])", r"\1 \2")
    if added:
        cut = pc.if_else(pc.match_substring_regex(words, added), words, cut)
    return pc.split_pattern(cut, " ")


def token_ids(tok: WordTokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in a row, and where each text begins (one more entry than texts).

    For tokenizers that lower case and never join what white space or a letter and a following
    punctuation mark part: each distinct word part is encoded once.
    """
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    parts = _word_parts(coded.dictionary, tok.added)
    distinct = parts.flatten().dictionary_encode()
    found = tok.ids(distinct.dictionary.to_pylist())
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, ends = _gather(np.frombuffer(b"".join(found), np.uint32), sizes, distinct.indices.to_numpy())
    per_word = np.diff(ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
    flat, ends = _gather(ids, per_word, coded.indices.to_numpy())
    return flat, ends[words.offsets.to_numpy() - words.offsets[0].as_py()]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``SLICE_BYTES`` of text, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield at, stop
        at = stop


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tok = tokenizer(path)
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        for a, b in _slices(texts):
            flat, ends = token_ids(tok, texts.slice(a, b - a))
            row, piece, start, length, crc, lists = [], [], [], [], [], []
            for r in range(b - a):
                ids = np.append(flat[ends[r] : ends[r + 1]], np.uint32(END_TOKEN)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(a + r)
                    piece.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        lists.append(part.astype(np.int32))
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                *(pa.array(c, pa.int64()) for c in (start, length, crc)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(columns, names=names)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: released(_pieces(batches, path, capacity, with_ids)), schema)


def bin_patterns(bins: int) -> np.ndarray:
    """Every way to fill ``bins`` with one to three parts, largest first, 0 for no part.

    Three parts may come to one bin more: their lengths fall short of the bins by half a bin each.
    """
    rows = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(bins - 1, (bins - 1) // 2, -1)]
    for total in (bins, bins + 1):
        for a in range(total - 2, 0, -1):
            rows += [(a, b, total - a - b) for b in range(min(a, total - a - 1), 0, -1) if b >= total - a - b]
    return np.array(rows)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set: repeats x with patterns * x near the histogram.

    ``histogram[b]`` counts pieces in bin b; entry 0 is not used. At most as many patterns as
    there are bins get repeats.
    """
    size = len(histogram)
    x, active = np.zeros(len(patterns)), np.zeros(len(patterns), bool)
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    target[0] = 0

    def used(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(rows[:, s], values, size) for s in range(rows.shape[1]))
        out[0] = 0
        return out

    for _ in range(rounds):
        rest = target - used(x, patterns)
        pull = rest[patterns].sum(axis=1)  # entry 0 of rest is 0
        pull[active] = -1
        best = int(pull.argmax())
        if pull[best] <= 1e-9:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            matrix = np.stack([np.bincount(p, minlength=size) for p in patterns[chosen]]).astype(float)
            matrix[:, 0] = 0
            gram = matrix @ matrix.T
            gram.flat[:: len(gram) + 1] += 1e-10
            solution = np.linalg.solve(gram, matrix @ target)
            if solution.min() > 0:
                x[:] = 0
                x[chosen] = solution
                break
            # Step towards the solution until the first repeat reaches zero.
            falling = solution <= 0
            part = (x[chosen][falling] / np.maximum(x[chosen][falling] - solution[falling], 1e-300)).min()
            x[chosen] += part * (solution - x[chosen])
            drop = chosen[(x[chosen] <= 1e-12) & falling]
            active[drop], x[drop] = False, 0
            if not active.any():
                break
        if not active.any():
            break
    return x * scale


def pattern_sequences(histogram: dict[int, int], capacity: int, bins: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences made by patterns, as (lengths, how many), and the lengths left over."""
    left = dict(histogram)
    width = -(-capacity // bins)
    queues: dict[int, deque] = {}
    for length in sorted(left, reverse=True):
        queues.setdefault(-(-length // width), deque()).append([length, left[length]])
    counts = np.zeros(-(-capacity // width) + 1)
    for length, n in left.items():
        counts[-(-length // width)] += n
    patterns = bin_patterns(len(counts) - 1)
    repeats = fit_repeats(patterns, counts)
    made = []
    for at in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[at] + 1e-6)
        if not wanted:
            break
        slots = [int(b) for b in patterns[at] if b]
        while wanted:
            # The first part is drawn longest first, the others shortest first, so that totals vary little.
            chosen: list = []
            for i, b in enumerate(slots):
                runs = queues.get(b, deque())
                free = (r for r in (runs if i == 0 else reversed(runs)) if r[1] > sum(c is r for c in chosen))
                run = next(free, None)
                if run is None:
                    break
                chosen.append(run)
            lengths = tuple(r[0] for r in chosen)
            if len(chosen) < len(slots) or sum(lengths) > capacity:
                break
            n = min(wanted, *(r[1] // sum(c is r for c in chosen) for r in chosen))
            made.append((lengths, n))
            for run in chosen:
                run[1] -= n
                left[run[0]] -= n
            for b in slots:
                queue = queues[b]
                while queue and not queue[0][1]:
                    queue.popleft()
                while queue and not queue[-1][1]:
                    queue.pop()
            wanted -= n
    return made, {length: n for length, n in left.items() if n}


def best_fit(made: list[tuple[tuple[int, ...], int]], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put the lengths left over into the fullest sequences they fit, longest first; then into new ones."""
    by_room: dict[int, list] = {}
    rooms: list[int] = []

    def add(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append((lengths, n))

    for lengths, n in made:
        add(lengths, n)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(count, each)
                if full:
                    add((length,) * each, full)
                if rest:
                    add((length,) * rest, 1)
                break
            room = rooms[at]
            lengths, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            # As many of this length as fit each, in as many sequences as there are pieces for.
            each = min(room // length, count)
            several = min(n, count // each)
            if several < n:
                add(lengths, n - several)
            add(lengths + (length,) * each, several)
            count -= several * each
    return [group for room in rooms for group in by_room[room]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many) that use up the histogram {length: pieces}."""
    made, left = pattern_sequences(histogram, capacity, min(bins, capacity))
    return best_fit(made, left, capacity)


def intervals(histogram: dict[int, int], sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns: first position, first sequence, offset. Positions number the pieces by length."""
    after, at = {}, 0
    for length in sorted(histogram):
        after[length], at = at, at + histogram[length]
    rows, sequence = [], 0
    for lengths, n in sequences:
        offset = 0
        for length in lengths:
            rows.append((after[length], sequence, offset))
            after[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


def _place(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    first, sequence, offset = table.value.T
    for batch in batches:
        position = batch.column("_position").to_numpy()
        at = np.searchsorted(first, position, "right") - 1
        others = [n for n in batch.schema.names if n != "_position"]
        columns = [batch.column(n) for n in others]
        placed = [pa.array(sequence[at] + position - first[at]), pa.array(offset[at])]
        yield pa.record_batch([*columns, *placed], names=[*others, "sequence_id", "offset"])


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (its place there) to every piece.

    What is broadcast has a row per part of a distinct sequence make-up, a few per length at
    most, so it is bounded by ``capacity`` and not by the number of pieces.
    """
    kept = materialise(found, "pieces")
    histogram = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    table = intervals(histogram, plan(histogram, capacity))
    placed = numbered(kept, [F.col("length"), F.col("doc_id"), F.col("piece")], "pieces-in-order")
    rows = placed.select(*found.columns, "_position")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    shared = found.sparkSession.sparkContext.broadcast(table)
    return rows.mapInArrow(lambda batches: _place(batches, shared), f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces with ids: whole sequences of at most a capacity of tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"))
