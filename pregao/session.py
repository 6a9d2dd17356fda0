"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs count on. Partition counts and memory belong to the cluster.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Scans aggregate as they read, so large splits cost no memory and send fewer partial rows.
    "spark.sql.files.maxPartitionBytes": "256m",
    # Target for the tasks and files of a ledger table.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


# Spark deletes the shuffle files of a query as it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "pregao", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    On a cluster without one that can be used, a folder of the warehouse, where executors write tables.
    Only where all processes are on one machine (``local``, ``local-cluster``) may either be
    machine-local, which elsewhere would lose rows with the executor that wrote them. A cluster
    whose machines mount one file system under the same path says so by ``file:`` in
    ``spark.checkpoint.dir``; a warehouse has that scheme by default, where it says nothing.
    Where nothing is said, as on a standalone cluster whose workers share a machine, the folders
    are tried out (``_reached_by_all``), first the setting, then the warehouse.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "").split("[")[0]
    one_machine = master in ("local", "local-cluster")
    if shared and (one_machine or ":" in shared.split("/")[0] or _default_scheme(spark) != "file"):
        return shared.rstrip("/")
    if master == "local":
        return _local_scratch()
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    own = f"{warehouse.rstrip('/')}/pregao-scratch" if warehouse else None
    if own and (one_machine or _scheme(spark, warehouse) != "file"):
        return own
    for folder in (shared, own):
        if folder and _reached_by_all(spark, folder):
            return folder.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def _scheme(spark: SparkSession, path: str) -> str:
    named, colon, _ = path.split("/")[0].partition(":")
    return named if colon else _default_scheme(spark)


def _default_scheme(spark: SparkSession) -> str:
    """Scheme of paths that name none."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return conf.get("fs.defaultFS", "file:///").split(":")[0]


@functools.cache
def _reached_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and all executors there are see one and the same folder under this path.

    Tried out once per session: several tasks for every core write a row each, and all rows must be read
    back. Of a machine-local folder the driver sees only what its own machine wrote. Where executors
    may come later, on other machines, nothing is known.
    """
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return False
    path = f"{folder.rstrip('/')}/pregao/probe-{uuid.uuid4().hex}"
    # Whatever fails here, such a folder is not known to be shared.
    with contextlib.suppress(Exception):
        rows = 4 * spark.sparkContext.defaultParallelism
        spark.range(0, rows, 1, rows).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
        _delete(spark, path)
        return found == rows
    return False


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="pregao-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder; never reused, so nothing is overwritten."""
    return f"{scratch_root(spark)}/pregao/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage for results that several plans use, and outlives executors. Nothing reads the
    shuffles of the write again, so they go with it and do not wait for the driver's garbage collector.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _setting(spark, SHUFFLES_END, "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def release(df: DataFrame) -> int:
    """Delete the materialised tables that ``df`` reads; how many there were.

    For the owner of a result that will not be read again. Tables elsewhere are
    never touched.
    """
    spark = df.sparkSession
    own = f"{scratch_root(spark)}/pregao/".split(":", 1)[-1].replace("//", "/")
    tables = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    found = [t for t in tables if own in t.replace("//", "/")]
    for table in found:
        _delete(spark, table)
    return len(found)
