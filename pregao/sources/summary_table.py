"""The stored summary behind the reports: a folder per grain and day, refreshed by day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.operators.measures import BY_TICKER, GRAINS, two_grain_summary
from pregao.operators.strategies import EVERY, Strategies, known_tests
from pregao.sources.ledger_table import (
    Day,
    day_folder,
    delete_folder,
    read_days,
    read_ledger,
    stored_days,
)

_GRAIN = "grao"


def write_summary(trades: DataFrame, path: str, strategies: Strategies = EVERY) -> None:
    """Summarise all trades and store the summary, in place of what is there."""
    _write(two_grain_summary(trades, strategies), path, "static")


def refresh_summary(
    spark: SparkSession, ledger: str, path: str, days: Iterable[Day], strategies: Strategies = EVERY
) -> None:
    """Bring the summary of the ledger table up to date for some days, reading only those.

    ``days`` are what ``load_days`` gave: their folders of the summary are written anew, and
    go if the ledger has no rows of them any more. Without a summary it is made from all days.
    """
    if not stored_days(spark, f"{path}/{_GRAIN}={BY_TICKER}"):
        write_summary(read_ledger(spark, ledger), path, strategies)
        return
    days, kept = set(days), set(stored_days(spark, ledger))
    if known_tests(read_summary(spark, path)) != known_tests(two_grain_summary(read_ledger(spark, ledger), strategies)):
        raise ValueError("the summary was made for other strategies; write it anew")
    if days & kept:
        _write(two_grain_summary(read_days(spark, ledger, days & kept), strategies), path, "dynamic")
    _drop_days(spark, path, days - kept)


def read_summary(spark: SparkSession, path: str, grain: str = BY_TICKER) -> DataFrame:
    """The summary of one grain: per day, ticker and set of strategies, or per trader as well."""
    if grain not in GRAINS:
        raise ValueError(f"no grain {grain}: {GRAINS}")
    stored = spark.read.parquet(path).where(f"{_GRAIN} = '{grain}'").drop(_GRAIN)
    if not isinstance(stored.schema["data"].dataType, T.DateType):
        stored = stored.withColumn("data", F.col("data").cast("date"))
    return stored.drop("nome") if grain == BY_TICKER else stored


def _write(summary: DataFrame, path: str, overwrite: str) -> None:
    # A day's summary is a few rows, so each day is one file.
    by_day = summary.repartition(_GRAIN, "data").sortWithinPartitions(_GRAIN, "data", "codigo")
    writer = by_day.write.mode("overwrite").option("partitionOverwriteMode", overwrite)
    writer.partitionBy(_GRAIN, "data").parquet(path)


def _drop_days(spark: SparkSession, path: str, days: set[Day]) -> None:
    for grain in GRAINS:
        for day in days:
            delete_folder(spark, f"{path}/{_GRAIN}={grain}/{day_folder(day)}")
