"""Vector codes: each part of a vector is named by the nearest entry of that part's codebook.

Vectors of whole numbers are cut into equal parts. Codebooks start from the rows of least
id and are refined by rounds: every part goes to its nearest entry, and each entry becomes the
componentwise floor of the mean of its parts. Whole numbers make sums exact, so neither
the order of rows nor the number of tasks changes a result.

The nearest entry is found by slicing and intersecting bitmasks. For every
dimension of a part the entries are sorted by their coordinate, and the masks of the first 0,
1, 2, ... of them are kept, 64 entries to a number. The distance to one entry near in
the first coordinates is the initial radius; in each dimension the entries within that
radius are a range of the sorted ones, whose mask is the difference of two prefixes. The AND of
the masks over all dimensions holds every entry that can be as near, and only those are measured.

A round is one pass over the stored whole-number vectors. What leaves a task, and what
reaches the driver, is bounded by the codebooks: a sum and a count per coordinate of an entry.

Defined results: rows whose vector is null or empty or holds null or non-finite components take
no part; of rows that share an id each is a row of its own, ordered by vector where that
matters; null ids come after all others; fewer rows than entries give smaller codebooks; null
labels are a label; an empty table gives no rows; other columns are not looked at. Vectors
of unequal length, of a length that the parts do not divide, or with components too
large for exact sums stop the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregao.session import materialise

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SLICE_ROWS = 4096
SALTS = 16  # rows of one label are dealt to so many tasks

Codebooks = list[np.ndarray]  # per part: entries x coordinates


def whole_numbers(table: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, ints) of the rows that take part; a component is the floor of its multiple."""
    usable = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    kept = table.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", ints.alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, after a look at their lengths and sizes."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} and of {sizes[sizes != width][0]} components")
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    # The squared distance of two whole vectors has to fit.
    limit = math.isqrt((1 << 62) // width) // 2
    if len(values) and max(int(values.max()), -int(values.min())) > limit:
        raise ValueError(f"a component of more than {limit} in whole numbers")
    return values


class Slices:
    """The sorted coordinates of a codebook and the masks of their prefixes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, self.words = len(entries), -(-len(entries) // 64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bit = np.zeros((count, self.words), np.uint64)
        bit[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count, dtype=np.uint64) % np.uint64(64))
        # prefixes[d, k]: the entries with the k least coordinates in dimension d
        self.prefixes = np.zeros((entries.shape[1], count + 1, self.words), np.uint64)
        for d in range(entries.shape[1]):
            self.prefixes[d, 1:] = np.bitwise_or.accumulate(bit[order[:, d]], axis=0)
        self.by_first = order[:, 0]

    def candidates(self, values: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that differ by no more than the radius in every dimension."""
        masks = None
        for d in range(values.shape[1]):
            low = np.searchsorted(self.sorted[:, d], values[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], values[:, d] + radius, "right")
            inside = self.prefixes[d, high] ^ self.prefixes[d, low]
            masks = inside if masks is None else masks & inside
        return masks

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row, the lower of equally near ones, and the squared distance."""
        near = np.searchsorted(self.sorted[:, 0], values[:, 0])
        best = np.full(len(values), len(self.entries), np.int64)
        least = np.full(len(values), np.iinfo(np.int64).max)
        for guess in (near - 1, near):
            some = self.by_first[np.clip(guess, 0, len(self.entries) - 1)]
            least = np.minimum(least, ((values - self.entries[some]) ** 2).sum(axis=1))
        # No nearer entry is farther than this in any dimension; one more makes up for the root's rounding.
        masks = self.candidates(values, np.sqrt(least.astype(np.float64)).astype(np.int64) + 1)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            distance = ((values[rows] - self.entries[e]) ** 2).sum(axis=1)
            # The first guess only bounds the distance, so an equal one still counts while no entry is named.
            better = (distance < least[rows]) | ((distance == least[rows]) & (best[rows] == len(self.entries)))
            best[rows[better]], least[rows[better]] = e, distance[better]
        return best, least


def assigned(books: Codebooks, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (rows x parts) and squared distance of every part."""
    width = books[0].shape[1]
    found = [Slices(book).nearest(values[:, p * width : (p + 1) * width]) for p, book in enumerate(books)]
    return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            rows = batch.slice(at, SLICE_ROWS)
            yield rows, _matrix(rows.column("ints"), width)


def _sums(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    """Sum and count per coordinate of every entry, over all rows of the task."""
    parts, (entries, width) = len(books), books[0].shape
    totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for _, values in _parts(batches, parts * width):
        entry, _ = assigned(books, values)
        for p in range(parts):
            np.add.at(totals[p], entry[:, p], values[:, p * width : (p + 1) * width])
            counts[p] += np.bincount(entry[:, p], minlength=entries)
    part, at = np.nonzero(counts)
    rows = [np.repeat(part, width), np.repeat(at, width), np.tile(np.arange(width), len(part))]
    rows += [totals[part, at].ravel(), np.repeat(counts[part, at], width)]
    yield pa.record_batch([pa.array(r.astype(np.int64)) for r in rows], names=["part", "entry", "place", "total", "n"])


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the rows of least id."""
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).collect()
    if not least:
        return []
    width, uneven = divmod(len(least[0]["ints"]), parts)
    if uneven:
        raise ValueError(f"{len(least[0]['ints'])} components in {parts} parts")
    values = _matrix(pa.array([r["ints"] for r in least], pa.list_(pa.int64())), parts * width)
    return [values[:, p * width : (p + 1) * width].copy() for p in range(parts)]


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds over all rows of ``vectors`` (vec_id, ints); none if there are no rows."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        schema = "part long, entry long, place long, total long, n long"
        sums = vectors.select("ints").mapInArrow(lambda batches, b=books: _sums(batches, b), schema)
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # a row per coordinate of an entry, whatever the table
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[pa.RecordBatch]:
    for rows, values in _parts(batches, len(books) * books[0].shape[1]):
        entry, distance = assigned(books, values)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(entry) + 1) * len(books), pa.int32()), pa.array(entry.ravel()))
        yield pa.record_batch([rows.column("vec_id"), rows.column("label"), lists, pa.array(distance.sum(axis=1))], names=["vec_id", "label", "entries", "error"])


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, entries, error): the entry of each part and the squared distances summed over parts."""
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, entries array<long>, error long"
    if not books:
        return vectors.sparkSession.createDataFrame([], schema)
    return vectors.mapInArrow(lambda batches: _coded(batches, books), schema)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``, the errors of all rows of the label summed.

    Sums combine on the map side. They come back by a join on the label and a salt, so rows of a
    hot label are spread, however many labels there are.
    """
    kept = materialise(rows, "vector-codes")
    none, name = F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_name")
    sums = kept.groupBy(none, name).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = kept.select("*", none, name, F.pmod(F.xxhash64("vec_id", "entries", "error"), F.lit(SALTS)).cast("int").alias("_salt"))
    return salted.join(sums, ["_none", "_name", "_salt"]).drop("_none", "_name", "_salt")
