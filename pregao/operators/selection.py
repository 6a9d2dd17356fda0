"""Choosing trades by date, and rooting their tickers."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregao.functions import ticker_root

DateBound = dt.date | str | None


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last trade date, the outer limits of a date choice."""
    return df.agg(F.min("data").alias("data_min"), F.max("data").alias("data_max"))


def date_range(df: DataFrame, start: DateBound = None, end: DateBound = None) -> DataFrame:
    """Trades from ``start`` to ``end``, both included.

    ``None`` leaves a side open. A blank text is a bound nobody entered, which
    no date satisfies. Rows without a date are in no range.
    """
    tests = ["data IS NOT NULL"]
    if start is not None:
        tests.append(f"data >= {_bound(start)}")
    if end is not None:
        tests.append(f"data <= {_bound(end)}")
    return df.where(" AND ".join(tests))


def _bound(value: dt.date | str) -> str:
    if isinstance(value, str):
        if not value.strip():
            return "CAST(NULL AS DATE)"
        value = dt.date.fromisoformat(value.strip())
    return f"DATE'{value:%Y-%m-%d}'"


def month_filter(df: DataFrame, month: int, year: int | None = None) -> DataFrame:
    """Trades of a calendar month, of any year unless one is given.

    With a year it is a date range, which skips row groups as well as folders.
    """
    if year is None:
        return df.where(f"MONTH(data) = {month:d}")
    last = calendar.monthrange(year, month)[1]
    return date_range(df, dt.date(year, month, 1), dt.date(year, month, last))


def root_tickers(df: DataFrame) -> DataFrame:
    return df.withColumn("codigo", F.expr(ticker_root()))
