"""Trade-result analytics on Spark: ledgers, intraday strategies and their scorecards."""

from pregao.operators.cleaning import clean
from pregao.operators.measures import daily_summary, scorecard, scorecards, strategy_totals
from pregao.operators.series import daily_cumulative
from pregao.plans import (
    for_display,
    ledger_in_range,
    month_report,
    overview,
    overview_of_summary,
    range_report,
    strategy_page,
)
from pregao.session import build_session, materialise, release
from pregao.sources import ledger_from_events, read_export, read_ledger, write_ledger

__all__ = [
    "build_session",
    "clean",
    "daily_cumulative",
    "daily_summary",
    "for_display",
    "ledger_from_events",
    "ledger_in_range",
    "materialise",
    "month_report",
    "overview",
    "overview_of_summary",
    "range_report",
    "read_export",
    "read_ledger",
    "release",
    "scorecard",
    "scorecards",
    "strategy_page",
    "strategy_totals",
    "write_ledger",
]
