"""The reports a user asks for, built from the operators."""

from pregao.plans.reports import (
    MonthReport,
    Overview,
    RangeReport,
    StrategyPage,
    for_display,
    headline,
    ledger_in_range,
    month_report,
    overview,
    overview_of_summary,
    range_report,
    strategy_page,
)

__all__ = [
    "MonthReport",
    "Overview",
    "RangeReport",
    "StrategyPage",
    "for_display",
    "headline",
    "ledger_in_range",
    "month_report",
    "overview",
    "overview_of_summary",
    "range_report",
    "strategy_page",
]
