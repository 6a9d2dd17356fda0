"""Ledger tables loaded by day, their summaries and bounds, and profiles taken on the way."""

from __future__ import annotations

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pregao.functions import exact_sum, from_exact
from pregao.operators import measures, profile, selection
from pregao.operators import strategies as st
from pregao.operators.cleaning import clean
from pregao.plans import overview, overview_of_summary
from pregao.sources import (
    load_days,
    read_days,
    read_export,
    read_ledger,
    read_summary,
    refresh_summary,
    stored_bounds,
    stored_days,
    write_ledger,
    write_profiled,
    write_summary,
)

from ledgers import ledger

FIRST = dt.date(2023, 1, 2)


def many_days(spark, days=219, per_day=3):
    """Trades of all kinds on so many days, and two without a date."""
    rng = random.Random(4)
    tickers = ["WINJ23", "WDOK23", "CCMK23", "PETR4", "VALE3", "ITUB4"]
    rows = [
        {
            "data": FIRST + dt.timedelta(days=d) if d < days else None,
            "hora": f"{rng.randint(9, 17):02d}:{rng.randint(0, 59):02d}:00",
            "codigo": rng.choice(tickers),
            "nome": rng.choice(["Ana", "Rui", None]),
            "liquido": rng.choice([-1, 1]) * rng.randint(1, 9999) / 100,
            "quantidade": rng.randint(1, 7),
        }
        for d in range(days + 1)
        for _ in range(per_day if d < days else 2)
    ]
    return clean(ledger(spark, *rows))


def same(a, b):
    return sorted(map(str, a.select(*["`" + c.replace("`", "``") + "`" for c in b.columns]).collect())) == sorted(map(str, b.collect()))


def test_one_day_replaces_itself_alone(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark)
    assert load_days(trades, path)[-1] is None and len(stored_days(spark, path)) == 220
    assert same(read_ledger(spark, path), trades)
    day = FIRST + dt.timedelta(days=100)
    again = trades.where(F.col("data") == day).withColumn("liquido", F.lit(1.5)).limit(2)
    for _ in range(2):  # twice changes nothing
        assert load_days(again, path) == [day]
        assert len(stored_days(spark, path)) == 220
        assert same(read_days(spark, path, [day]), again)
        others = trades.where(F.col("data").isNull() | (F.col("data") != day))
        assert same(read_ledger(spark, path).where(F.col("data").isNull() | (F.col("data") != day)), others)


def test_a_batch_that_fails_leaves_the_old_days(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark, 5)
    write_ledger(trades, path)
    broken = trades.withColumn("preco", F.when(F.col("data") == FIRST, F.raise_error(F.lit("torn file")).cast("double")).otherwise(F.col("preco")))
    with pytest.raises(Exception, match="torn file"):
        load_days(broken, path)
    assert same(read_ledger(spark, path), trades)


def test_undated_rows_are_a_day_of_their_own(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark, 4)
    load_days(trades, path)
    undated = trades.where("data IS NULL").limit(1)
    assert load_days(undated, path) == [None]
    assert same(read_ledger(spark, path), trades.where("data IS NOT NULL").unionByName(undated))
    assert load_days(trades.limit(0), path) == [] and read_ledger(spark, path).count() == 13


def test_days_that_a_batch_covers_but_has_no_rows_of_go(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark, 6)
    load_days(trades, path)
    days = [FIRST + dt.timedelta(days=d) for d in range(6)]
    assert load_days(trades.where(F.col("data") == days[2]), path, covering=(days[1], days[3])) == days[1:4]
    assert stored_days(spark, path) == [days[0], days[2], days[4], days[5], None]
    with pytest.raises(ValueError, match="outside"):
        load_days(trades, path, covering=(days[1], days[3]))
    assert len(stored_days(spark, path)) == 5


def test_other_columns_are_refused(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark, 3)
    load_days(trades, path)
    with pytest.raises(ValueError, match="extra int"):
        load_days(trades.withColumn("extra", F.lit(1)), path)
    with pytest.raises(ValueError, match="preco string"):
        load_days(trades.withColumn("preco", F.lit("x")), path)
    assert same(read_ledger(spark, path), trades)


def test_a_refreshed_summary_equals_a_rebuilt_one(spark, tmp_path):
    table, path, fresh = (str(tmp_path / n) for n in ("ledger", "summary", "fresh"))
    trades = many_days(spark, 30)
    day = FIRST + dt.timedelta(days=30)
    load_days(trades, table)
    refresh_summary(spark, table, path, [])  # made from all days
    one_more = trades.where("data IS NOT NULL").limit(9).withColumns({"data": F.lit(day), "liquido": F.col("liquido") * 2})
    touched = load_days(one_more, table)
    refresh_summary(spark, table, path, touched)
    write_summary(read_ledger(spark, table), fresh)
    for grain in measures.GRAINS:
        assert same(read_summary(spark, path, grain), read_summary(spark, fresh, grain))
    gone = load_days(one_more.limit(0), table, covering=(day, day))
    refresh_summary(spark, table, path, gone)
    write_summary(trades, fresh)
    for grain in measures.GRAINS:
        assert same(read_summary(spark, path, grain), read_summary(spark, fresh, grain))
    with pytest.raises(ValueError, match="other strategies"):
        refresh_summary(spark, table, path, [FIRST], (st.LEILAO,))


def test_a_refresh_reads_only_its_days(spark, tmp_path, capsys):
    path = str(tmp_path / "ledger")
    load_days(many_days(spark, 9), path)
    read_days(spark, path, [FIRST]).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line]
    assert len(filters) == 1 and str(FIRST) in filters[0]
    assert {r["data"] for r in read_days(spark, path, [FIRST, None]).select("data").collect()} == {FIRST, None}
    assert read_days(spark, path, []).count() == 0


def test_reports_from_both_grains_equal_those_of_trades(spark, tmp_path):
    path, trades = str(tmp_path / "summary"), many_days(spark, 40)
    write_summary(trades, path)
    bounds = (FIRST + dt.timedelta(days=5), FIRST + dt.timedelta(days=33))
    stored = overview_of_summary(read_summary(spark, path), *bounds)
    assert [same(a, b) for a, b in zip(stored, overview(trades, *bounds), strict=True)] == [True] * 3
    by_trader = selection.date_range(read_summary(spark, path, measures.BY_TRADER), *bounds)
    for s in (st.ABERTURA_FUTUROS, st.FUTUROS_TARDE, st.LEILAO):
        found = measures.totals_by_trader_of_summary(by_trader, (s,)).drop("ordem")
        assert same(found, measures.total_by_trader(selection.date_range(trades, *bounds), s))
    # Traders do not multiply the rows of the coarse grain, and the trades are read once.
    assert read_summary(spark, path).count() < read_summary(spark, path, measures.BY_TRADER).count()
    plan = measures.two_grain_summary(trades)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") == 1
    with pytest.raises(ValueError, match="no grain"):
        read_summary(spark, path, "dia")


def test_exact_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-8, 9) for _ in range(5000)] + [None, 0.0, -0.0, 2.0**40, 1e-300]
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(values)], "k int, x double")
    units = sum(round(Fraction(x) * 2**62) for x in values if x is not None)
    for n in (1, 3, 7):
        rows = df.repartition(n)
        assert rows.selectExpr(f"{exact_sum('x')} AS s").first()["s"] == units
        assert rows.selectExpr(f"{from_exact(exact_sum('x'))} AS s").first()["s"] == float(Fraction(units, 2**62))
        parts = rows.groupBy("k").agg(F.expr(exact_sum("x")).alias("s"))
        assert parts.agg(F.sum("s")).first()[0] == units
    assert df.limit(0).selectExpr(f"{exact_sum('x')} AS s").first()["s"] == 0
    with pytest.raises(Exception, match="(?i)overflow"):
        df.limit(1).selectExpr(f"{exact_sum('1e17D')} AS s").collect()


@pytest.mark.parametrize("strategy", [st.ABERTURA_FUTUROS, st.FUTUROS_TARDE, st.LEILAO])
def test_means_of_ratios_are_the_same_bits_over_any_partitions(spark, strategy):
    trades = many_days(spark, 60)
    cards = [sorted(map(str, measures.scorecard(trades.repartition(n), strategy, require_both_sides=False).collect())) for n in (1, 3, 7)]
    assert cards[0] == cards[1] == cards[2] and cards[0]


def rows_scanned(df) -> int:
    """Rows that the scan gave, by its own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_ticker_tests_reach_the_scan_and_pass_over_row_groups(spark, tmp_path, capsys):
    path = str(tmp_path / "ledger")
    tickers = ["WINJ23", "WDOK23", "CCMK23", "PETR4", "VALE3", "ITUB4", "BBDC4", "MGLU3"]
    listed = ", ".join(f"'{t}'" for t in tickers)
    wide = spark.range(60_000).selectExpr(
        "DATE'2023-01-02' AS data", "format_string('%02d:%02d:%02d', 9 + id % 8, id % 59, id % 53) AS hora",
        f"element_at(array({listed}), CAST(id % 8 AS INT) + 1) AS codigo", "id * 1D AS liquido", "uuid() AS nome",
    )
    spark.conf.set("parquet.block.size", str(1 << 18))
    spark._jsc.hadoopConfiguration().set("parquet.block.size", str(1 << 18))
    try:
        write_ledger(wide.coalesce(1), path)
    finally:
        spark.conf.unset("parquet.block.size")
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    stored = read_ledger(spark, path)
    expected = {
        st.MILHO: "StringStartsWith(codigo,CCM)",
        st.X_SALADA: "StringStartsWith(codigo,WDO)",
        st.LEILAO: "Not(StringStartsWith(codigo,WIN))",
        st.ABERTURA_FUTUROS_EX_CCM: "Not(StringStartsWith(codigo,CCM))",
    }
    for strategy, pushed in expected.items():
        chosen = st.select_strategy(stored, strategy)
        chosen.explain("formatted")
        filters = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
        assert pushed in filters
        assert chosen.count() == st.select_strategy(wide, strategy).count() or strategy is st.MILHO
    assert rows_scanned(st.select_strategy(stored, st.MILHO)) < 30_000
    assert rows_scanned(stored.where(st.X_SALADA.matches())) < 40_000


def test_families_by_prefix(spark):
    df = spark.createDataFrame([("WINJ23",), ("WI",), ("",), (None,), ("XWIN",), ("win",)], "codigo string")
    found = df.selectExpr("codigo", f"{st.in_families(('WIN', 'WDO'))} AS yes").collect()
    assert [r["yes"] for r in found] == [True, False, False, None, False, False]


def test_bounds_by_folders(spark, tmp_path):
    path, trades = str(tmp_path / "ledger"), many_days(spark, 12)
    load_days(trades, path)
    assert same(stored_bounds(spark, path), selection.date_bounds(trades))
    # A folder without rows does not count.
    (tmp_path / "ledger" / "data=2030-01-01").mkdir()
    trades.limit(0).drop("data").write.parquet(f"{path}/data=2029-01-01")
    assert same(stored_bounds(spark, path), selection.date_bounds(trades))
    undated = str(tmp_path / "undated")
    load_days(trades.where("data IS NULL"), undated)
    assert tuple(stored_bounds(spark, undated).first()) == (None, None)
    assert tuple(stored_bounds(spark, str(tmp_path / "none")).first()) == (None, None)


def test_a_profile_taken_while_writing_equals_the_queries(spark, tmp_path):
    trades = many_days(spark, 8).withColumn("odd `name`", F.lit(None).cast("int"))
    observed = write_profiled(trades, str(tmp_path / "ledger"))
    assert same(observed.shape(spark), profile.shape(trades))
    assert same(observed.null_profile(spark), profile.null_profile(trades))
    assert same(observed.column_types(spark), profile.column_types(trades))
    assert same(read_ledger(spark, str(tmp_path / "ledger")), trades)
    none = write_profiled(trades.limit(0), str(tmp_path / "none"))
    assert tuple(none.shape(spark).first()) == (0, len(trades.columns))


def exported(tmp_path, *texts):
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text, encoding="latin-1")
    return str(tmp_path)


def test_types_that_all_files_have(spark, tmp_path):
    head = "A,B,C,D,E,F,G,H,I\n"
    first = head + "1,1,1,True,True,,1e3,007,99999999999999999999\n2,2,2,false,,,inf,8,1\n"
    second = head + "-3,,2.5,TRUE,False,,.5,+9,2\n4,4,x,False,True,,-1,1,3\n"
    types = dict(read_export(spark, exported(tmp_path, first, second), infer=True).dtypes)
    assert types == {
        "a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "string",
        "f": "double", "g": "double", "h": "bigint", "i": "string",
    }
    assert dict(read_export(spark, str(tmp_path)).dtypes) == dict.fromkeys("abcdefghi", "string")
    rows = read_export(spark, str(tmp_path), infer=True, types={"a": "string"}).collect()
    assert sorted(r["a"] for r in rows) == ["-3", "1", "2", "4"] and sum(r["h"] for r in rows) == 25


@pytest.mark.parametrize("column", ["Data", "Datahora"])
def test_a_date_column_has_one_form(spark, tmp_path, column):
    mixed = exported(tmp_path, f"{column},Nota\n4/17/2023,x\n", f"{column},Nota\n2023-04-18,x\n,y\n")
    with pytest.raises(ValueError, match=f"{column} mixes .*4/17/2023.*2023-04-18"):
        read_export(spark, mixed, infer=True)
    for i, day in enumerate(("4/17/2023", "2023-04-17")):
        (tmp_path / str(i)).mkdir()
        read = read_export(spark, exported(tmp_path / str(i), f"{column}\n{day}\n"), infer=True)
        assert str(read.first()[0])[:10] == "2023-04-17"
