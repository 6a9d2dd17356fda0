"""Reports over cleaned trades.

Each report reads the trades once: it writes a summary with a row per day, trader, ticker
and set of strategies, as far as its tables need them, and every table is a lazy DataFrame
over that. ``session.release`` removes the summary behind a table that is no longer needed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from pregao.functions import currency_text
from pregao.operators import measures as m
from pregao.operators.selection import DateBound, date_range, month_filter, root_tickers
from pregao.operators.series import daily_totals_of_summary, running_total
from pregao.operators.strategies import OVERVIEW, WITHOUT_CORN, Strategy, tags
from pregao.session import materialise


class Overview(NamedTuple):
    totals: DataFrame
    running: DataFrame
    scorecards: DataFrame


class StrategyPage(NamedTuple):
    headline: DataFrame
    by_ticker: DataFrame
    by_trader: DataFrame
    scorecard: DataFrame


class RangeReport(NamedTuple):
    totals: DataFrame
    scorecards: DataFrame


class MonthReport(NamedTuple):
    totals: DataFrame
    running: DataFrame
    by_ticker: DataFrame
    by_trader: DataFrame
    scorecards: DataFrame


def ledger_in_range(
    trades: DataFrame, start: DateBound = None, end: DateBound = None
) -> DataFrame:
    """Trades of a date range with rooted tickers."""
    return root_tickers(date_range(trades, start, end))


def overview(
    trades: DataFrame,
    start: DateBound = None,
    end: DateBound = None,
    strategies: tuple[Strategy, ...] = OVERVIEW,
) -> Overview:
    """Totals and scorecards of all strategies, and the running total of the room."""
    chosen = date_range(trades, start, end)
    summary = materialise(m.daily_summary(chosen, strategies), "overview")
    return overview_of_summary(summary, strategies=strategies)


def overview_of_summary(
    summary: DataFrame,
    start: DateBound = None,
    end: DateBound = None,
    strategies: tuple[Strategy, ...] = OVERVIEW,
    root: bool = True,
) -> Overview:
    """The overview from a stored ``daily_summary``, for date choices that change often."""
    chosen = date_range(summary, start, end)
    per_ticker = m.per_strategy_of_summary(chosen, strategies, root)
    return Overview(
        m.strategy_totals_of_summary(per_ticker, strategies),
        running_total(daily_totals_of_summary(chosen)),
        m.scorecards_of_summary(per_ticker, strategies),
    )


def headline(totals: DataFrame) -> DataFrame:
    """Strategy totals as display text."""
    return totals.selectExpr("estrategia", f"{currency_text('resultado')} AS resultado")


def strategy_page(
    trades: DataFrame, strategy: Strategy, start: DateBound = None, end: DateBound = None
) -> StrategyPage:
    """Headline, totals per ticker and trader, and scorecard of one strategy."""
    chosen = date_range(trades, start, end).where(strategy.matches())
    per_trader = materialise(m.summarise(chosen, "nome", "codigo"), "page")
    summary = m.of_strategy_summary(per_trader, strategy)
    return StrategyPage(
        headline(m.strategy_totals_of_summary(summary, (strategy,))),
        m.total_by_ticker(summary, (strategy,)).drop("ordem").orderBy("codigo"),
        m.total_by_trader_of_summary(per_trader, strategy),
        m.scorecards_of_summary(summary, (strategy,)).drop("ordem"),
    )


def range_report(trades: DataFrame, start: DateBound, end: DateBound) -> RangeReport:
    """Totals to the cent and scorecards for typed-in dates, without corn.

    A date left blank selects nothing.
    """
    chosen = date_range(trades, start, end)
    tagged = m.summarise(chosen, "codigo", tags(WITHOUT_CORN))
    summary = m.per_strategy_of_summary(materialise(tagged, "range"), WITHOUT_CORN)
    return RangeReport(
        m.strategy_totals_of_summary(summary, WITHOUT_CORN, all_rounded=True),
        m.scorecards_of_summary(summary, WITHOUT_CORN),
    )


def month_report(trades: DataFrame, month: int, year: int | None = None) -> MonthReport:
    """The report of a calendar month, with contract months kept apart and without corn."""
    chosen = month_filter(trades, month, year)
    tagged = m.summarise(chosen, "data", "nome", "codigo", tags(WITHOUT_CORN))
    kept = materialise(tagged, "month")
    summary = m.per_strategy_of_summary(kept, WITHOUT_CORN, root=False)
    return MonthReport(
        m.strategy_totals_of_summary(summary, WITHOUT_CORN),
        running_total(daily_totals_of_summary(kept)),
        m.total_by_ticker(summary, WITHOUT_CORN).orderBy("ordem", "codigo"),
        m.totals_by_trader_of_summary(kept, WITHOUT_CORN, root=False),
        m.scorecards_of_summary(summary, WITHOUT_CORN),
    )


def for_display(card: DataFrame) -> DataFrame:
    """A scorecard under the column titles its readers know."""
    return card.withColumnRenamed("pct_vencedoras", "% vencedoras")
