"""The cleaned ledger as a Parquet table, one folder per trade date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.functions import three_letter_root
from pregao.operators.profile import Observed
from pregao.session import materialise, release

Day = dt.date | None
_FOLDER = "data="
# How Spark names the folder of rows without a date.
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def write_ledger(
    df: DataFrame, path: str, *, mode: str = "errorifexists", partitions: int | None = None
) -> None:
    """Store by ``data``, so that date filters prune folders.

    Rebalancing gives each date few, full files; adaptive execution splits a
    date that outgrows the advisory size over several tasks, so a day holding a
    third of all rows does not land on one. Rows are ordered by ticker family and time
    of day inside a file, which makes the row-group statistics of ``codigo`` and
    ``hora`` selective. ``partitions`` of about the number of dates, or more, keeps small
    dates from sharing a task with a split one; the session's shuffle partitions otherwise.

    ``mode="overwrite"`` replaces the whole table; ``load_days`` replaces days.
    """
    _store(_laid_out(df, partitions), path, mode, "static")


def write_profiled(
    df: DataFrame, path: str, *, mode: str = "errorifexists", partitions: int | None = None
) -> Observed:
    """``write_ledger``, and the profile of the rows that were written, from the same scan."""
    # Observed where rows are written, past the shuffle.
    observed = Observed(_laid_out(df, partitions))
    _store(observed.rows, path, mode, "static")
    return observed


def _store(rows: DataFrame, path: str, mode: str, overwrite: str) -> None:
    writer = rows.write.mode(mode).option("partitionOverwriteMode", overwrite)
    writer.partitionBy("data").parquet(path)


def _laid_out(df: DataFrame, partitions: int | None) -> DataFrame:
    layout = (F.col("data"),) if partitions is None else (partitions, F.col("data"))
    order = ["data", *[F.expr(three_letter_root())] * ("codigo" in df.columns), "hora"]
    return df.hint("rebalance", *layout).sortWithinPartitions(*order)


def load_days(
    batch: DataFrame,
    path: str,
    *,
    covering: tuple[dt.date, dt.date] | None = None,
    partitions: int | None = None,
) -> list[Day]:
    """Replace the days that a batch has rows of, and leave all others as they are; which they were.

    Rows without a date are a day of their own. The batch is computed once, into the shared
    folder; the days' files are written beside the table and moved in when all of them are there, so
    a batch that fails changes nothing, and loading the same batch again gives the same table.
    ``covering`` names the first and last day that the batch speaks for: stored days
    between them that it has no rows of are removed, and rows outside are refused. The first
    load makes the table; later ones need its columns.
    """
    spark = batch.sparkSession
    staged = materialise(batch, "batch")
    try:
        # A row per day, whatever the batch.
        days = sorted((r["data"] for r in staged.select("data").distinct().collect()), key=_day_order)
        gone = []
        if covering is not None:
            outside = [d for d in days if d is not None and not covering[0] <= d <= covering[1]]
            if outside:
                raise ValueError(f"days outside {covering[0]} to {covering[1]}: {', '.join(map(str, outside[:5]))}")
            known = stored_days(spark, path)
            gone = [d for d in known if d is not None and covering[0] <= d <= covering[1] and d not in days]
        if days:
            replace_partitions(staged, path, partitions)
    finally:
        release(staged)
    for day in gone:
        delete_folder(spark, f"{path}/{day_folder(day)}")
    return sorted([*days, *gone], key=_day_order)


def replace_partitions(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Replace the days that ``df`` has rows of."""
    spark = df.sparkSession
    if stored_days(spark, path):
        have = {f.name: f.dataType.simpleString() for f in read_ledger(spark, path).schema}
        given = {f.name: f.dataType.simpleString() for f in df.schema}
        if have != given:
            odd = sorted(set(have.items()) ^ set(given.items()))
            raise ValueError(f"the table has other columns: {', '.join(f'{n} {k}' for n, k in odd)}")
    _store(_laid_out(df, partitions), path, "overwrite", "dynamic")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read the table back with ``data`` as a date; rows without a date are kept."""
    stored = spark.read.parquet(path)
    if not isinstance(stored.schema["data"].dataType, T.DateType):
        stored = stored.withColumn("data", F.col("data").cast("date"))
    return stored


def read_days(spark: SparkSession, path: str, days: Iterable[Day]) -> DataFrame:
    """The rows of some days, from their folders alone."""
    days = set(days)
    dated = ", ".join(f"DATE'{d}'" for d in sorted(d for d in days if d is not None))
    tests = [f"data IN ({dated})"] * bool(dated) + ["data IS NULL"] * (None in days)
    return read_ledger(spark, path).where(" OR ".join(tests) or "FALSE")


def stored_days(spark: SparkSession, path: str) -> list[Day]:
    """The days of the table by its folders, without a look into any file; none if there is no table.

    None stands for rows without a date and comes last.
    """
    folder, files = _hadoop(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    found = [n.removeprefix(_FOLDER) for n in names if n.startswith(_FOLDER)]
    return sorted((None if n == _NO_DATE else dt.date.fromisoformat(n) for n in found), key=_day_order)


def stored_bounds(spark: SparkSession, path: str) -> DataFrame:
    """First and last trade date of the table, as ``date_bounds`` of its rows gives them.

    Reads the names of the folders. A folder counts if it holds a row, which the footers
    of its own files tell: folders are looked into from either end until one counts.
    """
    days = [d for d in stored_days(spark, path) if d is not None]

    def first(of: list[dt.date]) -> dt.date | None:
        # Any schema will do, as no column is read, and with one a folder may be empty.
        rows = (spark.read.schema("data date").parquet(f"{path}/{day_folder(d)}").select() for d in of)
        return next((d for d, r in zip(of, rows, strict=True) if not r.isEmpty()), None)

    bounds = (first(days), first(days[::-1]))
    return spark.createDataFrame([bounds], "data_min date, data_max date")


def _day_order(day: Day) -> tuple[bool, dt.date]:
    return day is None, day or dt.date.min


def day_folder(day: Day) -> str:
    return f"{_FOLDER}{_NO_DATE if day is None else day}"


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, files = _hadoop(spark, path)
    files.delete(folder, True)
