import datetime as dt

import pytest
from ledgers import ledger

from pregao.operators.selection import date_bounds, date_range, month_filter, root_tickers

DAYS = [dt.date(2023, 4, 3), dt.date(2023, 4, 17), dt.date(2024, 4, 1), dt.date(2023, 5, 2), None]


@pytest.fixture(scope="module")
def df(spark):
    return ledger(spark, *[{"data": d} for d in DAYS])


def days(frame):
    return sorted(r["data"] for r in frame.collect())


def test_bounds(df):
    assert tuple(date_bounds(df).first()) == (dt.date(2023, 4, 3), dt.date(2024, 4, 1))


@pytest.mark.parametrize(
    ("start", "end", "expected"),
    [
        (None, None, sorted(DAYS[:4])),
        (dt.date(2023, 4, 17), None, [DAYS[1], DAYS[3], DAYS[2]]),
        ("2023-04-03", "2023-04-17", DAYS[:2]),
        (None, "2023-04-16", DAYS[:1]),
        ("", None, []),
        (None, " ", []),
        ("2025-01-01", "2024-01-01", []),
    ],
)
def test_range_includes_both_ends_and_no_missing_date(df, start, end, expected):
    assert days(date_range(df, start, end)) == expected


def test_bad_bound(df):
    with pytest.raises(ValueError):
        date_range(df, "yesterday")


def test_month_of_any_year(df):
    assert days(month_filter(df, 4)) == DAYS[:3]
    assert days(month_filter(df, 4, 2024)) == [DAYS[2]]


def test_root_tickers(spark):
    df = ledger(spark, *[{"codigo": c} for c in ("WDOK23", "CCMU23", "VALE3", None)])
    assert [r["codigo"] for r in root_tickers(df).collect()] == ["WDO", "CCM", "VALE3", None]
