"""The next row in a total order, for tables too large for one sorted task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregao.llm.common import let, shuffle_partitions

LOWEST = -(1 << 63)


def _count_below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``value``, by two short scans instead of a long one."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def longs(values: list[int]) -> str:
        return f"array({','.join(f'{v}L' for v in values)})"

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda c: c < value))

    fine = F.expr(f"array({','.join(longs(g) for g in groups)})")
    coarse = F.expr(longs([g[0] for g in groups[1:]])) if len(groups) > 1 else F.expr("CAST(array() AS ARRAY<BIGINT>)")
    return let(below(coarse), lambda g: g * F.lit(step) + below(F.get(fine, g)))


def with_next(df: DataFrame, key: str, values: dict[str, Column], ties: list[Column], chunks: int | None = None) -> DataFrame:
    """Add to each row ``values`` of itself and, as ``next_<name>``, of the row after it.

    The order is descending ``key`` (whole numbers; null counts as the smallest), then
    ``ties``; after the last row comes the first. One shuffle: rows are dealt to chunks of
    neighbouring keys, cut at about equal row counts. A chunk's lowest rows find their
    successor in the chunk below, so the row at each cut is dealt to both. Rows that tie in
    everything are in any order; a table of one row is its own successor; an empty one gives no rows.
    """
    chunks = chunks or 4 * shuffle_partitions(df.sparkSession)
    order_key = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    shares = [i / chunks for i in range(1, chunks)]
    found = df.agg(
        F.percentile_approx(order_key, shares or [0.5], max(10_000, 10 * chunks)).alias("cuts"), F.max(order_key).alias("top")
    ).first()
    # Approximate shares are enough: cuts decide where rows meet, not which are neighbours.
    top = found["top"]
    cuts = sorted(set(found["cuts"]) - {top}) if found["cuts"] and chunks > 1 else []
    own = _count_below(cuts, F.col("_key"))
    at_cut = F.array_contains(F.expr(f"array({','.join(f'{c}L' for c in cuts)})"), F.col("_key")) if cuts else F.lit(False)
    homes = F.array_compact(
        F.array(
            F.struct(F.col("_chunk").alias("chunk"), F.lit(0).alias("echo")),
            F.when(at_cut, F.struct((F.col("_chunk") + 1).alias("chunk"), F.lit(1).alias("echo"))),
            F.when(F.col("_key") == F.lit(top if top is not None else 0), F.struct(F.lit(0).alias("chunk"), F.lit(2).alias("echo"))),
        )
    )
    dealt = (
        df.withColumn("_key", order_key)
        .withColumn("_chunk", own)
        .withColumn("_home", F.explode(homes))
        .repartition(shuffle_partitions(df.sparkSession), F.col("_home.chunk"))
        .withColumns(values)
    )
    # An echo stands below its chunk's own rows; the first row of all stands below everything.
    order = Window.partitionBy("_home.chunk").orderBy(F.col("_home.echo"), F.col("_key").desc(), *ties)
    following = {f"next_{v}": F.lead(v).over(order) for v in values}
    return dealt.withColumns(following).filter("_home.echo = 0").drop("_key", "_chunk", "_home")
