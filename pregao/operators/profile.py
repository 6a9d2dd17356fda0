"""A first look at a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_column(df: DataFrame, counts: dict[str, str], *labels: str) -> DataFrame:
    """One aggregate over all columns in a single pass, turned into a row per column.

    ``counts`` maps the fixed fields of a row to the count that follows them.
    """
    counted = df.agg(*[F.expr(c).alias(f"c{i}") for i, c in enumerate(counts.values())])
    rows = ", ".join(f"{fields}, c{i}" for i, fields in enumerate(counts))
    return counted.selectExpr(f"STACK({len(counts)}, {rows})").toDF(*labels)


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    counts = {_text(c): f"COUNT_IF({_name(c)} IS NULL)" for c in df.columns}
    return _per_column(df, counts, "coluna", "nulos")


def shape(df: DataFrame) -> DataFrame:
    """Number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("linhas")).withColumn(
        "colunas", F.lit(len(df.columns))
    )


def column_types(df: DataFrame) -> DataFrame:
    """Type and number of present values per column."""
    counts = {f"{_text(c)}, {_text(kind)}": f"COUNT({_name(c)})" for c, kind in df.dtypes}
    return _per_column(df, counts, "coluna", "tipo", "presentes")


def head(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first rows: any, or those smallest in a column."""
    return df.limit(n) if order_by is None else df.orderBy(order_by).limit(n)


class Observed:
    """The profile of rows that are on their way elsewhere, taken as they pass.

    ``rows`` are the rows to be written or counted. Once that job is done, the tables are
    there without another scan. For exact counts nothing may be shuffled after ``rows``: tasks that
    write are counted once each, while lost shuffle files would have theirs counted again.
    """

    def __init__(self, df: DataFrame):
        self._dtypes = df.dtypes
        self._observation = Observation()
        counts = [F.expr(f"COUNT_IF({_name(c)} IS NULL)").alias(f"c{i}") for i, c in enumerate(df.columns)]
        self.rows = df.observe(self._observation, F.count(F.lit(1)).alias("linhas"), *counts)

    def shape(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self._observation.get["linhas"], len(self._dtypes))], "linhas long, colunas int")

    def null_profile(self, spark: SparkSession) -> DataFrame:
        seen = self._observation.get
        rows = [(c, seen[f"c{i}"]) for i, (c, _) in enumerate(self._dtypes)]
        return spark.createDataFrame(rows, "coluna string, nulos long")

    def column_types(self, spark: SparkSession) -> DataFrame:
        seen = self._observation.get
        rows = [(c, kind, seen["linhas"] - seen[f"c{i}"]) for i, (c, kind) in enumerate(self._dtypes)]
        return spark.createDataFrame(rows, "coluna string, tipo string, presentes long")
