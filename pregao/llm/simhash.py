"""SimHash near-duplicate documents by a byte-position inverted index.

A fingerprint has 64 bits, seen as eight positional bytes. Fingerprints that differ
in ``max_bits`` bits differ in at most that many bytes, so they agree in at least
``8 - max_bits`` positions. The inverted index lists fingerprints under groups of
positional bytes, chosen so that any two fingerprints with that many agreements share
a list. Within a list the agreeing positional bytes of a pair are tallied, pairs below
the guaranteed number go, and the rest are verified by their differing bits.

A list under a single byte would hold every 256th fingerprint of the corpus and the
pairs would grow with its square; ``GROUP`` bytes together leave lists that hold little
but true neighbours. Lists that are still long are cut into blocks, and every pair of
blocks is a group of its own, so no task holds a whole list. Equal fingerprints are
one node, and a block gives at most a spanning forest of its links, never all pairs.

Defined results: a null or empty text has fingerprint zero, linked like any other;
a component is named by its least doc_id, or null if none of its rows has one; rows that
share a doc_id are rows of their own; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregao.llm.graph import components
from pregao.session import materialise

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BYTES = 8
GROUP = 3
BLOCK = 4096
# Says of many pairs of rows at once which ones.
Pairs = Callable[[np.ndarray, np.ndarray], np.ndarray]
# A-Z to a-z on UTF-8 bytes; no other byte changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    # bytes.split() cuts at space and at tab to carriage return, as the word rule asks.
    words = text.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    count = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: count - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.binary())]
        signed = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
        names = ["doc_id", "no_id", "key", "text_hash"]
        yield pa.record_batch([*[batch.column(c) for c in names], signed], names=[*names, "fingerprint"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, no_id, key, text_hash, fingerprint) of every row, the 64 bits as a signed long.

    ``key`` is the doc_id, or for rows without one (``no_id``) a hash of the text.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    return rows.mapInArrow(
        lambda batches: _fingerprints(batches, shingle),
        "doc_id long, no_id boolean, key long, text_hash long, fingerprint long",
    )


def index_groups(max_bits: int, group: int = GROUP) -> list[tuple[int, ...]]:
    """Groups of positions such that any ``BYTES - max_bits`` positions hold one of them."""
    agree = BYTES - max_bits
    if agree < 1:
        raise ValueError("max_bits must be below the number of bytes")
    group = min(group, agree)
    open_sets = {frozenset(s) for s in itertools.combinations(range(BYTES), agree)}
    every, chosen = list(itertools.combinations(range(BYTES), group)), []
    while open_sets:
        best = max(every, key=lambda g: sum(s.issuperset(g) for s in open_sets))
        open_sets = {s for s in open_sets if not s.issuperset(best)}
        chosen.append(best)
    return chosen


def links_and_open(
    key: np.ndarray,
    side: np.ndarray,
    values: np.ndarray,
    max_bits: int,
    able: Pairs | None = None,
    quick: Pairs | None = None,
    accept: Pairs | None = None,
    together: int = 1,
    reach: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal keys, as index pairs, and pairs left open.

    Row i is compared with row i + d of its run, for d = 1, 2, ... at once over all runs;
    pairs that earlier links already join are passed over. Two blocks of one list (sides 1
    and 2) are compared with each other, a single block (side 0) with itself. ``able`` says of
    many pairs at once which may be linked, ``quick`` which certainly are. Of the others ``accept`` is
    asked as soon as ``together`` wait; fewer are left open at the end. Without ``quick`` all pairs are links.
    ``reach`` says for each row before which one its partners end, that of the next row or a later one; else its run does.
    """
    size = len(values)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[starts[1:], size], np.diff(np.r_[starts, size])) if reach is None else reach
    root, found, i, step = np.arange(size), [], np.arange(size), 1
    fresh, open_ = [np.zeros((0, 2), np.int64)], np.zeros((0, 2), np.int64)

    def unite(pairs: np.ndarray) -> None:
        nonlocal root
        for x, y in pairs.tolist():
            p, q = x, y
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((x, y))
        while not np.array_equal(root, up := root[root]):
            root = up

    def apart(pairs: np.ndarray) -> np.ndarray:
        return pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]

    def settle() -> None:
        nonlocal open_
        pairs = apart(np.concatenate(fresh))
        fresh[1:] = []
        sure = np.ones(len(pairs), bool) if quick is None or not len(pairs) else quick(pairs[:, 0], pairs[:, 1])
        unite(pairs[sure])
        open_ = apart(np.concatenate([open_, pairs[~sure]]))
        if len(open_) >= together and accept is not None:
            unite(open_[accept(open_[:, 0], open_[:, 1])])
            open_ = open_[:0]

    while len(i := i[i + step < end[i]]):
        a = i[((side[i] == 0) | (side[i] != side[i + step])) & (root[i] != root[i + step])]
        differ = values[a] ^ values[a + step]
        if max_bits < BYTES:
            agreeing = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            a, differ = a[agreeing >= BYTES - max_bits], differ[agreeing >= BYTES - max_bits]
        a = a[np.bitwise_count(differ) <= max_bits]
        if able is not None and len(a):
            a = a[able(a, a + step)]
        if len(a):
            fresh.append(np.stack([a, a + step], axis=1))
            if quick is None or sum(map(len, fresh)) >= together // 4:
                settle()
        step += 1
    settle()
    return np.array(found, np.int64).reshape(-1, 2), open_


def list_links(
    key: np.ndarray, side: np.ndarray, values: np.ndarray, max_bits: int, able: Pairs | None = None, reach: np.ndarray | None = None
) -> np.ndarray:
    """The links of ``links_and_open`` where all pairs that are ``able`` are links."""
    return links_and_open(key, side, values, max_bits, able, reach=reach)[0]


def whole_runs(
    batches: Iterator[pa.RecordBatch], keys: int = 2, most: int | None = None
) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Sorted rows in tables that never cut a run of equal leading ``keys``, with a number per run.

    The last run of a batch waits for its rest in the next one. A table has no more than ``most`` rows
    and those of one run.
    """
    if most:
        batches = (b.slice(at, most) for b in batches for at in range(0, len(b), most))
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if held is None or not len(held):
            continue
        columns = [held.column(k).to_numpy() for k in range(keys)]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        ends = np.flatnonzero(change)
        done = len(held) if batch is None else int(ends[-1]) + 1 if len(ends) else 0
        if done:
            yield np.cumsum(np.r_[True, change[: done - 1]]), held.slice(0, done)
            held = held.slice(done)


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for run, rows in whole_runs(batches):
        values = rows.column("fingerprint").to_numpy()
        ends = list_links(run, rows.column("side").to_numpy(), values.view(np.uint64), max_bits)
        yield pa.record_batch([pa.array(values[ends[:, 0]]), pa.array(values[ends[:, 1]])], names=["u", "v"])


def in_blocks(index: DataFrame, sizes: DataFrame, block: int, how: str, by: str = "fingerprint") -> DataFrame:
    """Deal the rows (list, ``by``) of long lists to pairs of blocks: adds ``pair`` and ``side``.

    ``sizes`` (list, rows) names the lists to be cut; others are one block (``how`` "left") or
    go ("inner"). Block b meets every block: as side 0 with itself, 1 with later ones, 2 with
    earlier ones.
    """
    blocks = F.coalesce(F.ceil(F.col("rows") / F.lit(block)), F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64(by), F.col("blocks"))
    dealt = index.join(sizes, "list", how).withColumn("blocks", blocks).withColumn("own", own)
    # Plain columns, as Spark compiles no stage with a lambda in it.
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.least("o", "own") * F.lit(1 << 32) + F.greatest("o", "own")
    side = F.when(F.col("o") == F.col("own"), 0).when(F.col("o") > F.col("own"), 1).otherwise(2).cast("long")
    return met.select("list", pair.alias("pair"), side.alias("side"), by)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v) pairs of ``distinct`` fingerprints whose closure is that of all links."""
    groups = index_groups(max_bits)

    def key(positions: tuple[int, ...], number: int) -> Column:
        bytes_ = [F.shiftrightunsigned("fingerprint", 8 * p).bitwiseAND(F.lit(255)) for p in positions]
        packed = F.lit(number).cast("long")
        for b in bytes_:
            packed = F.shiftleft(packed, 8).bitwiseOR(b)
        return packed

    index = distinct.select(
        "fingerprint", F.explode(F.array(*[key(g, i) for i, g in enumerate(groups)])).alias("list")
    )
    # A list of one row has no pairs.
    sizes = index.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    listed = in_blocks(index, sizes, block, "inner")
    runs = listed.repartition("list", "pair").sortWithinPartitions("list", "pair")
    return runs.mapInArrow(lambda batches: _links(batches, max_bits), "u long, v long")


def _classes(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of the rows, component per fingerprint, and least row per component."""
    prints = materialise(fingerprints(docs, shingle), "simhash")
    least = F.min(F.struct("no_id", "key"))
    nodes = prints.groupBy("fingerprint").agg(least.alias("least"))
    joined = components(links(nodes.select("fingerprint"), max_bits), "simhash-links")
    named = nodes.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    named = materialise(named, "simhash-nodes")
    firsts = named.groupBy("component").agg(F.min("least").alias("first")).select("component", "first.*")
    return prints, named.select("fingerprint", "component"), firsts


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the least doc_id reachable over links."""
    prints, named, firsts = _classes(docs, shingle, max_bits)
    names = firsts.select("component", F.when(~F.col("no_id"), F.col("key")).alias("component_id"))
    classes = named.join(names, "component").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicate documents: that of the least doc_id.

    Rows without a doc_id come after all others, by a hash of their text; of a group's rows with
    the same least id the one with the least text hash stays. Unlike documents that share an
    id are in groups of their own, so each of them stays.
    """
    prints, named, firsts = _classes(docs, shingle, max_bits)
    keyed = docs.withColumns(
        {
            "_none": F.col("doc_id").isNull(),
            "_key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")),
            "_hash": F.xxhash64("text"),
        }
    )
    # Which text of a group's least key stays: the hashes of all texts of that key, of which few are in one group.
    wanted = firsts.select("component", F.col("no_id").alias("_none"), F.col("key").alias("_key"))
    members = prints.select(F.col("no_id").alias("_none"), F.col("key").alias("_key"), "text_hash", "fingerprint").join(named, "fingerprint")
    chosen = members.join(wanted, ["component", "_none", "_key"]).groupBy("component", "_none", "_key").agg(F.min("text_hash").alias("_hash"))
    # Rows of one id and text are alike, so any one of them will do; a group of copies has many ids.
    rows = Window.partitionBy("_none", "_key", "_hash").orderBy(F.lit(0))
    kept = keyed.join(chosen.select("_none", "_key", "_hash"), ["_none", "_key", "_hash"], "left_semi")
    return kept.withColumn("_row", F.row_number().over(rows)).filter("_row = 1").select(docs.columns)
