"""Results over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregao.functions import money_decimals, money_sum


def daily_totals(trades: DataFrame) -> DataFrame:
    """Net result per day over all trades, in a strategy or not."""
    return _per_day(trades, money_sum("liquido", money_decimals(trades)))


def daily_totals_of_summary(summary: DataFrame) -> DataFrame:
    return _per_day(summary, "SUM(ganhos + perdas)")


def _per_day(df: DataFrame, total: str) -> DataFrame:
    return df.where("data IS NOT NULL").groupBy("data").agg(F.expr(total).alias("liquido"))


def running_total(days: DataFrame) -> DataFrame:
    """Running total over daily totals.

    The window has no partition and so runs in one task, which is bounded: it
    sees one row per calendar day, whatever the number of trades.
    """
    so_far = "ORDER BY data ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return days.selectExpr(
        "data",
        "CAST(liquido AS DOUBLE) AS liquido",
        f"CAST(SUM(liquido) OVER ({so_far}) AS DOUBLE) AS acumulado",
    ).orderBy("data")


def daily_cumulative(trades: DataFrame) -> DataFrame:
    return running_total(daily_totals(trades))
