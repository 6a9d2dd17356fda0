import pytest
from ledgers import ledger

from pregao.operators.selection import root_tickers
from pregao.operators.strategies import (
    OVERVIEW,
    PAGES,
    WITHOUT_CORN,
    select_strategy,
    strategy_tags,
)

TIMES = (
    "08:59:59 09:00:00 09:05:00 09:05:01 09:59:59 10:00:00 11:59:59 12:00:00 14:59:59 15:00:00 "
    "17:00:00 17:00:01"
).split()
FUTURE = [[], [0], [0], [1], [1], [1], [1], [1], [1], [1], [1], [5]]
CORN = [[4], [0, 4], [0, 4], *[[4]] * 9]
SHARE = [[], [0], [0], [], [], [2], [2], [], [], [3], [3], [3]]


@pytest.mark.parametrize(
    ("codigo", "expected"), [("WINJ23", FUTURE), ("CCMK23", CORN), ("PETR4", SHARE)]
)
@pytest.mark.parametrize("rooted", [False, True])
def test_window_edges(spark, codigo, expected, rooted):
    df = ledger(spark, *[{"codigo": codigo, "hora": t} for t in TIMES])
    df = root_tickers(df) if rooted else df
    tags = {(r["hora"], r["ordem"]) for r in strategy_tags(df).collect()}
    assert tags == {(t, o) for t, os in zip(TIMES, expected, strict=True) for o in os}
    for s in OVERVIEW:
        assert {(r["hora"], s.ordem) for r in select_strategy(df, s).collect()} == {
            tag for tag in tags if tag[1] == s.ordem
        }


def test_pages_leave_corn_out_of_the_opening(spark):
    df = ledger(
        spark, *[{"codigo": c, "hora": "09:00:00"} for c in ("CCMK23", "WINJ23", "PETR4")]
    )
    tags = {(r["codigo"], r["ordem"]) for r in strategy_tags(df, PAGES).collect()}
    assert tags == {("CCMK23", 4), ("WINJ23", 0), ("PETR4", 0)}


def test_unknown_ticker_or_time(spark):
    df = ledger(spark, {"codigo": None, "hora": "09:00:00"}, {"codigo": "WINJ23", "hora": None})
    assert [r["ordem"] for r in strategy_tags(df).collect()] == [0]


def test_sets():
    assert PAGES[1:] == OVERVIEW[1:]
    assert [s.ordem for s in OVERVIEW] == list(range(6))
    assert [s.ordem for s in WITHOUT_CORN] == [0, 1, 2, 3, 5]
