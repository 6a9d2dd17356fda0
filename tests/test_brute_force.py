"""Random ledgers with every kind of gap, against plain Python loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from ledgers import SCHEMA

from pregao.operators import measures as m
from pregao.operators import strategies as st
from pregao.operators.cleaning import clean
from pregao.operators.series import daily_cumulative

EDGES = (
    "08:59:59 09:00:00 09:05:00 09:05:01 09:59:59 10:00:00 11:59:59 12:00:00 14:59:59 15:00:00 "
    "17:00:00 17:00:01"
).split()
# A third of all trades are in the first ticker.
TICKERS = ["WINJ23"] * 7 + "WINM23 WDOK23 DOLJ23 INDV23 CCMK23 CCMU23 PETR4 VALE3 WING11 CCMX3".split() + [None, "B3"]
FUTURES, ALL = ("WDO", "WIN", "DOL", "IND"), ("WDO", "WIN", "DOL", "IND", "CCM")


def random_rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)

    def result():
        return rnd.choice([None, 0.0, float("nan"), round(rnd.uniform(-50, 50), 2), round(rnd.gauss(0, 9), 4)])

    return [
        (
            rnd.choice([None] + [dt.date(2023, 4, 28) + dt.timedelta(d) for d in range(9)]),
            rnd.choice(EDGES),
            rnd.choice(["a", "b", None]),
            rnd.choice(TICKERS),
            rnd.choice(["Compra", "Venda", None]),
            rnd.choice([0, 1, 5, 100]),
            rnd.choice([0.0, 1.5, 20.0]),
            result(),
            result(),
            rnd.choice([None, 10, 31999, 32000]),
        )
        for _ in range(n)
    ]


def missing(x):
    return x is None or x != x


def closed(rows):
    for data, hora, nome, codigo, _, quantidade, preco, bruto, liquido, duracao in rows:
        if liquido == 0 or bruto == 0 or duracao is None or duracao >= 32000 or data is None:
            continue
        liquido = None if missing(liquido) else liquido
        per_unit = [
            liquido / unit if liquido is not None and unit else None
            for unit in (quantidade, preco * quantidade)
        ]
        yield data, hora, nome, codigo, liquido, duracao, *per_unit


def member(ordem, hora, codigo):
    if ordem == 0:
        return "09:00:00" <= hora <= "09:05:00"
    if codigo is None:
        return False
    family = codigo[:3]
    return {
        1: family in FUTURES and "09:05:00" < hora <= "17:00:00",
        2: family not in ALL and "10:00:00" <= hora < "12:00:00",
        3: family not in ALL and hora >= "15:00:00",
        4: family == "CCM",
        5: family in FUTURES and hora > "17:00:00",
    }[ordem]


def mean(xs):
    return sum(xs) / len(xs) if xs else None


@pytest.mark.parametrize(("seed", "n"), [(1, 3000), (2, 200), (3, 12)])
def test_reports(spark, seed, n):
    rows = random_rows(seed, n)
    trades = clean(spark.createDataFrame(rows, SCHEMA).repartition(5)).where("data IS NOT NULL")
    kept = list(closed(rows))

    groups, totals, days = defaultdict(list), dict.fromkeys(range(6), 0.0), defaultdict(float)
    for t in kept:
        data, hora, _, codigo, liquido = t[:5]
        days[data] += liquido or 0.0
        for ordem in range(6):
            if member(ordem, hora, codigo):
                root = codigo[:3] if codigo and codigo[:3] in ALL else codigo
                groups[ordem, root].append(t)
                totals[ordem] += liquido or 0.0

    cards = {}
    for (ordem, codigo), ts in groups.items():
        wins = [t[4] for t in ts if t[4] is not None and t[4] > 0]
        losses = [t[4] for t in ts if t[4] is not None and t[4] < 0]
        if not wins or not losses or codigo is None or ordem == 4:
            continue
        share = ordem in (2, 3)
        unit = mean([t[7] for t in ts if t[7] is not None] if share else [t[6] for t in ts if t[6] is not None])
        cards[ordem, codigo] = {
            "liquido": sum(wins) + sum(losses),
            "media_melhores": mean(wins),
            "qtd_melhores": len(wins),
            "melhor": max(wins),
            "media_piores": mean(losses),
            "qtd_piores": len(losses),
            "pior": (max if share else min)(losses),
            "valor_por_contrato": None if share or unit is None else unit,
            "valor_por_acao": unit * 100 if share and unit is not None else None,
            "duracao": mean([t[5] for t in ts]),
            "pct_vencedoras": len(wins) / (len(wins) + len(losses)),
        }

    got = {}
    for r in m.scorecards(trades).collect():
        row = r.asDict()
        got[row.pop("ordem"), row.pop("codigo")] = row
    assert set(got) == set(cards)
    for key, card in cards.items():
        for column, value in card.items():
            near = value if value is None else pytest.approx(value, abs=0.00501)
            assert got[key][column] == near, (key, column)

    for r in m.strategy_totals(trades).collect():
        assert r["resultado"] == pytest.approx(totals[r["ordem"]], abs=0.05), r
    exact = {r["ordem"]: r["resultado"] for r in m.strategy_totals(trades).collect()}
    assert [exact[i] for i in (2, 3, 5)] == [pytest.approx(totals[i], abs=1e-6) for i in (2, 3, 5)]

    running, so_far = [], 0.0
    for day in sorted(days):
        so_far += days[day]
        running.append((day, pytest.approx(days[day], abs=1e-6), pytest.approx(so_far, abs=1e-6)))
    assert [tuple(r) for r in daily_cumulative(trades).collect()] == running

    tags = sum(member(o, t[1], t[3]) for t in kept for o in range(6))
    assert st.strategy_tags(trades).count() == tags
