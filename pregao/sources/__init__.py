"""Where ledgers come from and where they are kept."""

from pregao.sources.events import ledger_from_events
from pregao.sources.export_csv import read_export, write_export
from pregao.sources.ledger_table import (
    load_days,
    read_days,
    read_ledger,
    stored_bounds,
    stored_days,
    write_ledger,
    write_profiled,
)
from pregao.sources.summary_table import read_summary, refresh_summary, write_summary

__all__ = [
    "ledger_from_events",
    "load_days",
    "read_days",
    "read_export",
    "read_ledger",
    "read_summary",
    "refresh_summary",
    "stored_bounds",
    "stored_days",
    "write_export",
    "write_ledger",
    "write_profiled",
    "write_summary",
]
