"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pregao.session import materialise

# White space of the word rules: space and the controls from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def released(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of ``found``; at its end Arrow gives back the memory it keeps, as a Python worker serves many tasks."""
    yield from found
    pa.default_memory_pool().release_unused()


def numbered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Add ``_position``: the gapless place (from 0) of each row in the given order.

    One range shuffle; rows are counted where they lie, and only one row per
    partition meets in the running total. A key with many rows is spread as long
    as the later order columns tell its rows apart. Rows that tie completely get
    places in any order. The numbered rows are a written table, so every reader
    sees the same places.
    """
    parts = shuffle_partitions(df.sparkSession)
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    kept = materialise(placed, label).withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kept.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    # One row per partition: bounded by the partition count, whatever the data.
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumn("_position", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_before")
    )
