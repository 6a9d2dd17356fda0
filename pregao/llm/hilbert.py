"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``2 ** bits`` levels of about equal weight, the
levels give a place on the curve, and the rows in curve order are cut into runs of
equal counts. Rows that are alike in all dimensions share a shard, so a filter on any
of the dimensions skips most files.

Defined results: a null in a dimension is below all its values; an empty table
gives no rows; equal rows get neighbouring places; columns beyond those named pass
through untouched, but for old columns named like the results, which are replaced. Names
starting with an underscore are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.llm.common import numbered

BITS = 5
# Coarse bins of a dimension: at most 65,536 for text (two bytes) and 16 per power of two for numbers.
BINS_PER_OCTAVE = 16


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """State machine of the curve: digit and next state for ``state * 2**dims + cell``.

    A state is the orientation of a sub-cube: its entry corner and its main axis.
    The cells of a sub-cube are walked in Gray code order, turned by the state.
    """
    size = 1 << dims

    def turn(value: int, by: int) -> int:
        by %= dims
        return ((value << by) | (value >> (dims - by))) & (size - 1)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def axis(i: int) -> int:
        if i == 0:
            return 0
        ones = i if i % 2 else i - 1
        return (((ones + 1) & -(ones + 1)).bit_length() - 1) % dims

    digits, states = [], []
    for state in range(size * dims):
        corner, main = divmod(state, dims)
        for cell in range(size):
            digit = rank[turn(cell ^ corner, dims - (main + 1) % dims)]
            digits.append(digit)
            states.append((corner ^ turn(entry(digit), main + 1)) * dims + (main + axis(digit) + 1) % dims)
    return digits, states


def curve_index(levels: list[Column], bits: int) -> Column:
    """Place on the curve of the cell with these levels."""
    dims = len(levels)
    digits, states = (F.expr(f"array({','.join(map(str, t))})") for t in curve_steps(dims))
    state, index = F.lit(0), F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        cell = F.lit(0)
        for i, level in enumerate(levels):
            cell = cell + F.shiftleft(F.shiftright(level, bit).bitwiseAND(F.lit(1)), i)
        at = state * F.lit(1 << dims) + cell
        index = index * F.lit(1 << dims) + F.get(digits, at)
        state = F.get(states, at)
    return index


def _bin(df: DataFrame, name: str, low, high) -> Column:
    """Order-preserving coarse bin of a dimension; -1 for null."""
    if low is None:
        return F.lit(-1)
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        a, b = low.encode(), high.encode()
        shared = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        code = F.rpad(F.hex(F.substring(column.cast("binary"), shared + 1, 2)), 4, "0")
        return F.coalesce(F.conv(code, 16, 10).cast("int"), F.lit(-1))
    above = F.greatest(column.cast("double") - F.lit(float(low)), F.lit(0.0))
    place = F.floor(F.log2(above + 1) * BINS_PER_OCTAVE).cast("int")
    return F.when(column.isNull(), -1).otherwise(place)


def level_cuts(histogram: list[tuple[int, int]], levels: int) -> list[int]:
    """Bins at which the level rises, once per step, so that levels have about equal weight."""
    total, before, cuts, level = sum(n for _, n in histogram), 0, [], 0
    for bin_, n in sorted(histogram):
        reached = min(levels - 1, math.floor(levels * (before + n / 2) / total))
        cuts += [bin_] * (reached - level)
        level, before = reached, before + n
    return cuts


def with_curve(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Add ``hilbert``, the place of each row's metadata on the curve.

    Reads the dimension columns twice: once for their ranges, once for exact counts
    per coarse bin. Only the ranges and those counts (bounded by the number of bins)
    reach the driver.
    """
    for d in dimensions:
        if isinstance(df.schema[d].dataType, (T.FloatType, T.DoubleType)):
            raise TypeError(f"dimension {d}: whole numbers or text are needed")
    ranges = df.agg(*[f(d).alias(f"{k}{i}") for i, d in enumerate(dimensions) for k, f in (("a", F.min), ("z", F.max))]).first()
    bins = [_bin(df, d, ranges[f"a{i}"], ranges[f"z{i}"]) for i, d in enumerate(dimensions)]
    one_each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), b.alias("bin")) for i, b in enumerate(bins)]))
    counts = df.select(one_each.alias("x")).groupBy("x.dim", "x.bin").count().collect()
    levels = []
    for i, b in enumerate(bins):
        cuts = level_cuts([(r["bin"], r["count"]) for r in counts if r["dim"] == i], 1 << bits) if counts else []
        levels.append(sum(((b >= c).cast("int") for c in cuts), F.lit(0)))
    named = {f"_level{i}": level for i, level in enumerate(levels)}
    return df.withColumns(named).withColumn("hilbert", curve_index([F.col(c) for c in named], bits)).drop(*named)


def cut_runs(df: DataFrame, shards: int, ties: list[Column], label: str = "hilbert") -> DataFrame:
    """Cut the curve order into ``shards`` runs whose counts differ by one at most.

    Adds ``shard`` and ``slot``, the gapless place inside it. ``ties`` orders the rows of
    one cell; it should end in a key, so that a cell with very many rows is spread.
    """
    placed = numbered(df, [F.col("hilbert"), *ties], label)
    rows = placed.count()
    shard = F.expr(f"CAST(_position * {shards} DIV {max(rows, 1)} AS INT)")
    start = F.expr(f"(shard * CAST({rows} AS BIGINT) + {shards - 1}) DIV {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_position") - start).drop("_position")


def hilbert_shards(
    df: DataFrame, dimensions: list[str], shards: int, ties: list[Column], bits: int = BITS
) -> DataFrame:
    """Rows of ``df`` with ``hilbert``, ``shard`` (0 to shards - 1) and ``slot``."""
    return cut_runs(with_curve(df, dimensions, bits), shards, ties)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a folder per shard, rows in curve order, so that row groups have narrow ranges.

    Each shard is its own sort key range, so a large one is written by several tasks.
    """
    rows = sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
