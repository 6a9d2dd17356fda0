import datetime as dt
from dataclasses import replace

import pytest
from ledgers import as_dicts, ledger
from pyspark.sql import functions as F

from pregao.operators import measures as m
from pregao.operators import strategies as st
from pregao.operators.cleaning import clean
from pregao.operators.selection import month_filter
from pregao.operators.series import daily_cumulative
from pregao.plans import (
    for_display,
    month_report,
    overview,
    overview_of_summary,
    range_report,
    reports,
    strategy_page,
)
from pregao.session import materialise


def trades(spark, *rows):
    return clean(ledger(spark, *rows))


def assert_close(got, expected):
    """Equal but for the last digits of means of ratios, which depend on row order."""
    for a, b in zip(got.collect(), expected.collect(), strict=True):
        assert list(a) == [pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in b]


def with_results(codigo, *results, **more):
    return [{"codigo": codigo, "liquido": r, **more} for r in results]


ONE_SIDED = [
    *with_results("A3", 1.0, 2.0),
    *with_results("B3", -1.0, -2.0),
    *with_results("C3", 3.0, -1.0),
    *with_results("D3", None),
]


def test_a_scorecard_needs_both_sides(spark):
    df = trades(spark, *ONE_SIDED)
    card = as_dicts(m.scorecard(df, st.ABERTURA_ACOES))
    assert [r["codigo"] for r in card] == ["C3"]
    every = as_dicts(m.scorecard(df, st.ABERTURA_ACOES, require_both_sides=False))
    assert {r["codigo"]: r["pct_vencedoras"] for r in every} == {
        "A3": 1.0, "B3": 0.0, "C3": 0.5, "D3": None,
    }


def test_part_tables_of_one_sided_tickers(spark):
    summary = m.of_strategy(trades(spark, *ONE_SIDED), st.ABERTURA_ACOES)
    cards = (st.ABERTURA_ACOES,)
    assert {r["codigo"] for r in as_dicts(m.winners(summary, cards))} == {"A3", "C3"}
    assert {r["codigo"] for r in as_dicts(m.losers(summary, cards))} == {"B3", "C3"}
    totals = {r["codigo"]: r["liquido"] for r in as_dicts(m.total_by_ticker(summary, cards))}
    assert totals == {"A3": 3.0, "B3": -3.0, "C3": 2.0, "D3": 0.0}


def test_worst_is_the_smallest_loss_for_shares_and_the_largest_for_futures(spark):
    results = (10.0, -1.0, -5.0)
    share = trades(spark, *with_results("PETR4", *results))
    future = trades(spark, *with_results("WINJ23", *results))
    assert as_dicts(m.scorecard(share, st.ABERTURA_ACOES))[0]["pior"] == -1.0
    assert as_dicts(m.scorecard(future, st.FUTUROS_TARDE))[0]["pior"] == -5.0


def test_scorecard_columns_and_values(spark):
    df = trades(
        spark,
        {"liquido": 10.0, "quantidade": 100, "preco": 20.0, "duracao": 10},
        {"liquido": 5.125, "quantidade": 100, "preco": 20.0, "duracao": 11},
        {"liquido": -4.0, "quantidade": 200, "preco": 10.0, "duracao": 12},
        {"liquido": None, "quantidade": 200, "preco": 10.0, "duracao": 14},
    )
    card = m.scorecard(df, st.ABERTURA_ACOES)
    assert card.columns == [
        "codigo", "liquido", "media_melhores", "qtd_melhores", "melhor", "media_piores",
        "qtd_piores", "pior", "valor_por_acao", "duracao", "pct_vencedoras",
    ]
    (row,) = as_dicts(card)
    assert row.pop("valor_por_acao") == pytest.approx((0.005 + 0.0025625 - 0.002) / 3 * 100)
    assert row == {
        "codigo": "PETR4", "liquido": 11.12, "media_melhores": 7.56, "qtd_melhores": 2,
        "melhor": 10.0, "media_piores": -4.0, "qtd_piores": 1, "pior": -4.0, "duracao": 11.75,
        "pct_vencedoras": 0.67,
    }


def test_display_order(spark):
    rows = [*with_results("A3", 2.0, -1.0), *with_results("B3", 9.0, -1.0)]
    assert [r["codigo"] for r in as_dicts(m.scorecard(trades(spark, *rows), st.ABERTURA_ACOES))] == ["B3", "A3"]
    rows = [*with_results("WIN", 2.0, -1.0), *with_results("DOL", 1.0, -1.0), *with_results("IND", 9.0, -1.0)]
    assert [r["codigo"] for r in as_dicts(m.scorecard(trades(spark, *rows), st.FUTUROS_TARDE))] == ["DOL", "IND", "WIN"]


def test_contract_months_fold_or_stay(spark):
    rows = [
        *with_results("WINJ23", 2.0, -1.0, hora="17:30:00"),
        *with_results("WINM23", 3.0, -1.0, hora="17:30:00"),
        *with_results("WINJ23", 2.0, -1.0, hora="11:00:00"),
        *with_results("WINM23", 3.0, -1.0, hora="11:00:00"),
    ]
    df = trades(spark, *rows)

    def tickers(root):
        return [(r["ordem"], r["codigo"], r["liquido"]) for r in as_dicts(m.scorecards(df, root=root))]

    assert tickers(True) == [(1, "WIN", 3.0), (5, "WIN", 3.0)]
    assert tickers(False) == [(1, "WINJ23", 1.0), (1, "WINM23", 2.0), (5, "WIN", 3.0)]
    assert [r["codigo"] for r in as_dicts(m.scorecard(df, st.FUTUROS_TARDE, root=False))] == ["WINJ23", "WINM23"]
    assert [r["codigo"] for r in as_dicts(m.scorecard(df, st.X_SALADA, root=False))] == ["WIN"]


def test_total_of_rounded_tickers_differs_from_the_rounded_total(spark):
    cents = [*with_results("WIN", 0.004), *with_results("DOL", 0.004), *with_results("IND", 0.004)]
    rows = [{**r, "hora": t} for r in cents for t in ("11:00:00", "17:30:00", "09:00:00")]
    totals = {r["ordem"]: r["resultado"] for r in as_dicts(m.strategy_totals(trades(spark, *rows)))}
    assert totals[1] == 0.0
    assert totals[5] == 0.012
    assert totals[0] == 0.01
    rounded = m.strategy_totals(trades(spark, *rows), st.WITHOUT_CORN, all_rounded=True)
    assert {r["ordem"]: r["resultado"] for r in as_dicts(rounded)} == {
        0: 0.01, 1: 0.0, 2: 0.0, 3: 0.0, 5: 0.01,
    }


def test_empty_ledger(spark):
    df = trades(spark)
    totals = as_dicts(m.strategy_totals(df))
    assert [(r["estrategia"], r["resultado"]) for r in totals] == [
        (s.label, 0.0) for s in st.OVERVIEW
    ]
    assert m.scorecards(df).count() == 0
    assert m.scorecard(df, st.LEILAO).count() == 0
    assert daily_cumulative(df).count() == 0


def test_only_missing_results(spark):
    df = trades(spark, {"liquido": None, "codigo": "CCMK23"})
    assert as_dicts(daily_cumulative(df)) == [
        {"data": dt.date(2023, 4, 3), "liquido": 0.0, "acumulado": 0.0}
    ]
    assert {r["resultado"] for r in as_dicts(m.strategy_totals(df))} == {0.0}


def test_running_total_over_days(spark):
    rows = [
        {"data": dt.date(2023, 4, 5), "liquido": 0.1},
        {"data": dt.date(2023, 4, 3), "liquido": 0.2, "hora": "13:00:00"},
        {"data": dt.date(2023, 4, 4), "liquido": None},
        {"data": None, "liquido": 50.0},
    ]
    got = [(r["data"].day, r["liquido"], r["acumulado"]) for r in as_dicts(daily_cumulative(trades(spark, *rows)))]
    assert got == [(3, 0.2, 0.2), (4, 0.0, 0.2), (5, 0.1, 0.3)]


def test_missing_ticker_counts_in_totals_but_has_no_row(spark):
    rows = [{"codigo": None, "hora": "09:01:00", "liquido": x} for x in (3.0, -1.0)]
    df = trades(spark, *rows)
    assert as_dicts(m.strategy_totals(df))[0]["resultado"] == 2.0
    assert as_dicts(daily_cumulative(df))[0]["liquido"] == 2.0
    assert m.scorecard(df, st.ABERTURA_FUTUROS).count() == 0
    assert m.total_by_ticker(m.per_strategy(df), st.OVERVIEW).count() == 0
    assert m.total_by_trader(df, st.ABERTURA_FUTUROS).count() == 0
    assert overview(df).scorecards.count() == 0


def test_traders(spark):
    rows = [
        {"nome": n, "codigo": c, "liquido": x}
        for n, c, x in [("a", "WINJ23", 1.0), ("a", "WINM23", 2.0), ("b", "WINJ23", -1.5), (None, "WINJ23", 9.0)]
    ]
    got = {(r["nome"], r["codigo"], r["liquido"]) for r in as_dicts(m.total_by_trader(trades(spark, *rows), st.FUTUROS_TARDE))}
    assert got == {("a", "WIN", 3.0), ("b", "WIN", -1.5)}


def test_fractional_durations(spark):
    df = ledger(spark, *with_results("PETR4", 1.0, -1.0)).withColumn("duracao", F.lit(0.25))
    assert as_dicts(m.scorecard(clean(df), st.ABERTURA_ACOES))[0]["duracao"] == 0.25


@pytest.fixture(scope="module")
def sample(spark):
    from checks.queries import trades as sample_trades

    return sample_trades(spark, "/root/testdata/sf0.001").where("data IS NOT NULL").cache()


@pytest.mark.parametrize("strategy", st.with_scorecard(st.PAGES + (st.ABERTURA_FUTUROS,)), ids=lambda s: f"{s.key}-{len(s.without)}")
def test_join_form_equals_the_fold(sample, strategy):
    one = (strategy,)
    summary = m.of_strategy(sample, strategy)
    unit = m.mean_value_per_share if strategy.unit == st.PER_SHARE else m.mean_value_per_contract
    joined = m.scorecard_join(
        m.total_by_ticker(summary, one),
        m.winners(summary, one),
        m.losers(summary, one),
        unit(summary),
        m.mean_duration(summary, one),
    ).drop("ordem")
    folded = m.scorecard(sample, strategy)
    assert joined.columns == folded.columns

    assert_close(joined.orderBy("codigo"), folded.orderBy("codigo"))


def test_decided_trades_are_the_known_ones(sample):
    for s in st.with_scorecard(st.OVERVIEW):
        known = st.select_strategy(sample, s).where("liquido IS NOT NULL").count()
        decided = m.of_strategy(sample, s).agg({"qtd_melhores": "sum", "qtd_piores": "sum"}).first()
        assert sum(decided) == known


def test_corn_is_the_difference_between_the_openings(sample):
    def total(strategies):
        return m.strategy_totals(sample, strategies).first()["resultado"]

    # A trade without a ticker is not known to be no corn.
    corn = st.select_strategy(sample, st.ABERTURA_FUTUROS).where(
        "codigo LIKE 'CCM%' OR codigo IS NULL"
    )
    assert total(st.OVERVIEW) - total(st.PAGES) == pytest.approx(
        corn.agg({"liquido": "sum"}).first()[0], abs=0.011
    )


def test_last_running_total_is_the_grand_total(sample):
    last = as_dicts(daily_cumulative(sample))[-1]["acumulado"]
    assert last == pytest.approx(sample.agg({"liquido": "sum"}).first()[0], abs=1e-6)


@pytest.mark.parametrize("bounds", [(None, None), ("2024-02-01", "2024-12-31"), ("", None)])
def test_summary_serves_every_date_choice(sample, bounds):
    summary = m.daily_summary(sample)
    stored, direct = overview_of_summary(summary, *bounds), overview(sample, *bounds)
    assert stored.totals.collect() == direct.totals.collect()
    assert stored.running.collect() == direct.running.collect()
    assert_close(stored.scorecards, direct.scorecards)


def test_summary_serves_every_selection_of_strategies(sample):
    summary = m.daily_summary(sample)
    pages = overview_of_summary(summary, strategies=st.PAGES)
    assert pages.totals.collect() == overview(sample, strategies=st.PAGES).totals.collect()
    assert_close(pages.scorecards, overview(sample, strategies=st.PAGES).scorecards)
    april = overview_of_summary(month_filter(summary, 4), strategies=st.WITHOUT_CORN, root=False)
    assert april.totals.collect() == month_report(sample, 4).totals.collect()
    assert april.running.collect() == month_report(sample, 4).running.collect()
    assert_close(april.scorecards, month_report(sample, 4).scorecards)


def test_strategy_page(sample):
    for s in st.with_scorecard(st.PAGES):
        page = strategy_page(sample, s)
        total = [r for r in m.strategy_totals(sample, st.PAGES).collect() if r["ordem"] == s.ordem]
        assert page.headline.first()["resultado"] == f"R$ {total[0]['resultado']:,.2f}"
        assert page.by_ticker.columns == ["codigo", "liquido"]
        assert page.scorecard.count() <= page.by_ticker.count()


def test_scorecards_take_one_scan_and_no_join(sample, capsys):
    m.scorecards(sample).explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and "CartesianProduct" not in plan and "Python" not in plan
    assert plan.count("InMemoryTableScan") == 1


def test_typed_dates(sample):
    blank = range_report(sample, "", "2024-12-31")
    assert {r["resultado"] for r in blank.totals.collect()} == {0.0}
    assert blank.scorecards.count() == 0
    typed = range_report(sample, "2024-02-01", "2024-12-31")
    assert_close(typed.scorecards, overview(sample, "2024-02-01", "2024-12-31").scorecards)


def test_month_report_keeps_contract_months(sample):
    report = month_report(sample, 4)
    assert [r["estrategia"] for r in report.totals.collect()] == [s.label for s in st.WITHOUT_CORN]
    tickers = {(r["ordem"], r["codigo"]) for r in report.scorecards.collect()}
    assert all(len(codigo) == 3 for ordem, codigo in tickers if ordem == 5)
    assert any(len(codigo) > 3 for ordem, codigo in tickers if ordem == 1)


def test_display_title(sample):
    assert for_display(m.scorecard(sample, st.LEILAO)).columns[-1] == "% vencedoras"


def test_amounts_with_many_decimals(spark):
    df = trades(spark, *with_results("PETR4", 0.00004)).crossJoin(spark.range(1000)).drop("id")
    assert as_dicts(m.strategy_totals(df))[2]["resultado"] == pytest.approx(0.04, rel=1e-9)
    assert as_dicts(daily_cumulative(df))[0]["acumulado"] == pytest.approx(0.04, rel=1e-9)


def test_sums_need_the_mode_that_notices_overflow(spark):
    df = trades(spark, *with_results("PETR4", 9e14, 9e14, 9e14))
    with pytest.raises(Exception, match="OVERFLOW"):
        m.strategy_totals(df).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(ValueError, match="ansi"):
            m.strategy_totals(df)
        with pytest.raises(ValueError, match="ansi"):
            daily_cumulative(df)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_strategies_that_share_a_place(sample):
    with pytest.raises(ValueError, match="ordem"):
        m.scorecards(sample, st.EVERY)
    with pytest.raises(ValueError, match="ordem"):
        m.strategy_totals(sample, st.EVERY)
    keyed = m.scorecards(sample, st.EVERY, with_key=True).collect()
    for s in (st.ABERTURA_FUTUROS, st.ABERTURA_FUTUROS_EX_CCM):
        own = sum(r["qtd_melhores"] for r in keyed if r["chave"] == s.key)
        assert own == sum(r["qtd_melhores"] for r in m.scorecard(sample, s).collect())


def test_a_twin_and_a_strategy_of_the_same_number_do_not_mix(sample):
    twin = replace(st.LEILAO, key="gemeo", ordem=9)
    alone = as_dicts(m.scorecard(sample, st.LEILAO))
    both = as_dicts(m.scorecards(sample, (st.LEILAO, twin)))
    for number in (3, 9):
        own = [r for r in both if r["ordem"] == number]
        assert [r["qtd_melhores"] for r in own] == [r["qtd_melhores"] for r in alone]
    other = replace(st.LEILAO, key="outro", ordem=4)
    with pytest.raises(ValueError, match="ordem"):
        m.scorecards(sample, (other, replace(st.X_SALADA, ordem=4)))
    cards = as_dicts(m.scorecards(sample, (st.MILHO, st.X_SALADA, replace(other, ordem=7))))
    wins = sum(r["qtd_melhores"] for r in cards if r["ordem"] == 5)
    assert wins == sum(r["qtd_melhores"] for r in m.scorecard(sample, st.X_SALADA).collect())
    with pytest.raises(ValueError, match="key"):
        m.scorecards(sample, (st.LEILAO, st.LEILAO))


def test_a_summary_knows_its_strategies(sample, tmp_path):
    with pytest.raises(ValueError, match="ex_ccm"):
        overview_of_summary(m.daily_summary(sample, st.OVERVIEW), strategies=st.PAGES)
    own = replace(st.FUTUROS_TARDE, key="own", until="10:00:00")
    with pytest.raises(ValueError, match="own"):
        overview_of_summary(m.daily_summary(sample), strategies=(own,))
    m.daily_summary(sample).write.parquet(str(tmp_path / "s"))
    stored = sample.sparkSession.read.parquet(str(tmp_path / "s"))
    assert overview_of_summary(stored).totals.collect() == m.strategy_totals(sample).collect()
    plain = stored.selectExpr("* EXCEPT (tags)", "tags + 0 AS tags")
    with pytest.raises(ValueError, match="does not say"):
        overview_of_summary(plain)


def test_a_report_reads_the_trades_once(sample, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    sample.write.parquet(path)
    trades_ = sample.sparkSession.read.parquet(path)
    written = []

    def counted(df, label):
        written.append(label)
        return materialise(df, label)

    monkeypatch.setattr(reports, "materialise", counted)
    for made in (
        lambda: overview(trades_),
        lambda: strategy_page(trades_, st.LEILAO),
        lambda: range_report(trades_, "2024-01-01", None),
        lambda: month_report(trades_, 4),
    ):
        written.clear()
        report = made()
        assert len(written) == 1
        for table in report:
            assert table.inputFiles() and not any(path in f for f in table.inputFiles())


def test_traders_in_reports(sample):
    page = strategy_page(sample, st.FUTUROS_TARDE)
    assert_close(page.by_trader, m.total_by_trader(sample, st.FUTUROS_TARDE))
    report = month_report(sample, 4)
    april = month_filter(sample, 4)
    for s in st.WITHOUT_CORN:
        own = report.by_trader.where(f"ordem = {s.ordem}").drop("ordem")
        assert_close(own, m.total_by_trader(april, s, root=False))


def test_large_sums_stay_exact(spark):
    rows = with_results("PETR4", 123456789.01, 987654321.99, -0.01)
    df = trades(spark, *rows).crossJoin(spark.range(1000)).drop("id")
    assert as_dicts(m.strategy_totals(df))[2]["resultado"] == 1111111110990.0
