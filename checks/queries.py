"""Registered queries: each takes (spark, folder of Parquet tables) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pregao.functions import snake_case_all, three_letter_root, ticker_root
from pregao.operators import cleaning, measures, profile, selection, series
from pregao.operators import strategies as st
from pregao.plans import (
    headline,
    ledger_in_range,
    month_report,
    overview,
    overview_of_summary,
    range_report,
    strategy_page,
)
from pregao.session import materialise, scratch_path
from pregao.sources import (
    ledger_from_events,
    load_days,
    read_export,
    read_ledger,
    read_summary,
    refresh_summary,
    stored_bounds,
    write_export,
    write_ledger,
    write_profiled,
    write_summary,
)

Query = Callable[[SparkSession, str], DataFrame]

RANGE = ("2024-01-20", "2025-02-10")
MONTH = 4
SHARE_CARDS = (st.ABERTURA_ACOES, st.LEILAO)
CONTRACT_CARDS = (st.ABERTURA_FUTUROS, st.FUTUROS_TARDE, st.X_SALADA)
CARDS = st.with_scorecard(st.OVERVIEW)


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    # A stated schema saves the job that would read file footers for one.
    return ledger_from_events(spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet"))


def trades(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean(ledger(spark, folder))


def in_range(spark: SparkSession, folder: str) -> DataFrame:
    """All dates, tickers rooted: what the reports start from."""
    return ledger_in_range(trades(spark, folder))


def _rows_of(strategy: st.Strategy) -> Query:
    def query(spark, folder):
        rows = st.select_strategy(trades(spark, folder), strategy)
        return ledger_in_range(rows).select("event_id", "data", "hora", "codigo", "liquido")

    return query


def _scorecard(strategy: st.Strategy) -> Query:
    def query(spark, folder):
        dated = selection.date_range(trades(spark, folder))
        return measures.scorecard(dated, strategy)

    return query


def _by_ticker(strategy: st.Strategy) -> Query:
    return lambda spark, folder: strategy_page(trades(spark, folder), strategy).by_ticker


def _by_trader(strategy: st.Strategy, root: bool = True) -> Query:
    def query(spark, folder):
        dated = selection.date_range(trades(spark, folder))
        return measures.total_by_trader(dated, strategy, root)

    return query


def _month_summary(spark, folder) -> DataFrame:
    chosen = selection.month_filter(trades(spark, folder), MONTH)
    return measures.per_strategy(chosen, CARDS, root=False)


def fractional_running(spark, folder):
    """Amounts far below a cent add up like any others."""
    tiny = trades(spark, folder).withColumn("liquido", F.expr("liquido * 1e-6D"))
    rounded = [F.round(c, 9).alias(c) for c in ("liquido", "acumulado")]
    return series.daily_cumulative(tiny).select("data", *rounded)


def _summary(spark, folder, strategies) -> DataFrame:
    dated = selection.date_range(trades(spark, folder))
    return measures.per_strategy(dated, strategies)


def scorecard_join(spark, folder):
    strategy = (st.LEILAO,)
    dated = selection.date_range(trades(spark, folder))
    # Five joined tables would each scan the ledger; the summary has a row per ticker.
    summary = materialise(measures.of_strategy(dated, st.LEILAO), "leilao")
    joined = measures.scorecard_join(
        measures.total_by_ticker(summary, strategy),
        measures.winners(summary, strategy),
        measures.losers(summary, strategy),
        measures.mean_value_per_share(summary),
        measures.mean_duration(summary, strategy),
    )
    return joined.drop("ordem")


def headline_currency(spark, folder):
    dated = selection.date_range(trades(spark, folder))
    pages = (st.ABERTURA_FUTUROS_EX_CCM, st.FUTUROS_TARDE, st.X_SALADA)
    return headline(measures.strategy_totals(dated, pages))


EXPORT_HEADERS = {
    "event_id": "EventId",
    "data": "Data",
    "hora": "Hora",
    "nome": "Nome",
    "codigo": "Codigo",
    "lado": "Lado",
    "quantidade": "Quantidade",
    "preco": "Preco",
    "bruto": "Bruto",
    "liquido": "Liquido",
    "duracao": "Duracao",
}


def as_export(df: DataFrame) -> DataFrame:
    """A ledger with the headers of an export, a combined time and an accented column."""
    return df.selectExpr(
        *[f"{c} AS {header}" for c, header in EXPORT_HEADERS.items()],
        "CONCAT(CAST(data AS STRING), ' ', hora) AS Datahora",
        "CONCAT('Operação de ', lado) AS `Descrição-Operação`",
    )


def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "export")
    write_export(as_export(ledger(spark, folder)), path, missing="NaN")
    return cleaning.clean(read_export(spark, path)).withColumns(
        {
            "event_id": F.col("event_id").cast("bigint"),
            "datahora": F.col("datahora").cast("string"),
        }
    )


def csv_messy(spark, folder):
    """An export with missing tokens, quotes and commas, month-first dates and times to the minute."""
    path = scratch_path(spark, "messy")
    written = ledger(spark, folder).selectExpr(
        "event_id AS EventId",
        "DATE_FORMAT(data, 'M/d/yyyy') AS Data",
        "CONCAT(DATE_FORMAT(data, 'M/d/yyyy'), ' ', LTRIM('0', LEFT(hora, 5))) AS Datahora",
        "COALESCE(codigo, '#N/A') AS Codigo",
        "CONCAT(quantidade, '.0') AS Quantidade",
        "COALESCE(CAST(liquido AS STRING), 'N/A') AS Liquido",
        "CONCAT('lado \"', lado, '\", ', hora) AS `Nota Livre`",
    )
    write_export(written, path)
    return read_export(spark, path).selectExpr(
        "CAST(event_id AS BIGINT) AS event_id",
        "data",
        "CAST(datahora AS STRING) AS datahora",
        "codigo",
        "quantidade",
        "liquido",
        "`nota livre` AS nota",
    )


def header_normalisation(spark, folder):
    return snake_case_all(as_export(ledger(spark, folder)))


def parquet_ledger(spark, folder):
    path = scratch_path(spark, "ledger")
    write_ledger(trades(spark, folder), path)
    return selection.date_range(read_ledger(spark, path), *RANGE)


def stored_summary(spark, folder) -> DataFrame:
    return materialise(measures.daily_summary(trades(spark, folder)), "daily")


def loaded_by_day(spark, folder) -> str:
    """A ledger table of all but some days, with others half there, after a load of the rest."""
    path = scratch_path(spark, "days")
    rows = trades(spark, folder)
    late = "data IS NULL OR DAY(data) % 3 = 0"
    write_ledger(rows.where(f"NOT ({late}) OR (DAY(data) = 6 AND event_id % 2 = 0)"), path)
    batch = rows.where(late)
    load_days(batch, path)
    load_days(batch, path)
    return path


def refreshed_summary(spark, folder) -> str:
    """The summary of a ledger table whose days came in two loads, refreshed after the second."""
    ledger_path, path = scratch_path(spark, "days"), scratch_path(spark, "summary")
    rows = trades(spark, folder)
    late = "data IS NULL OR DAY(data) % 5 = 0"
    load_days(rows.where(f"NOT ({late}) OR event_id % 2 = 0"), ledger_path)
    write_summary(read_ledger(spark, ledger_path), path)
    refresh_summary(spark, ledger_path, path, load_days(rows.where(late), ledger_path))
    return path


def summary_by_trader(spark, folder):
    """Totals per trader for a date choice, from the finer grain of the stored summary."""
    path = scratch_path(spark, "summary")
    write_summary(trades(spark, folder), path)
    chosen = selection.date_range(read_summary(spark, path, measures.BY_TRADER), *RANGE)
    return measures.totals_by_trader_of_summary(chosen, st.WITHOUT_CORN)


def folder_bounds(spark, folder):
    path = scratch_path(spark, "ledger")
    write_ledger(trades(spark, folder), path)
    return stored_bounds(spark, path)


def profile_in_write(spark, folder):
    """Rows, columns, types and missing values of the ledger, counted while it was written."""
    observed = write_profiled(ledger(spark, folder), scratch_path(spark, "ledger"))
    per_column = observed.column_types(spark).join(observed.null_profile(spark), "coluna")
    rows = observed.shape(spark).first()
    return per_column.withColumns({"linhas": F.lit(rows["linhas"]).cast("long"), "colunas": F.lit(rows["colunas"])})


def csv_inferred(spark, folder):
    """Two exports whose fields clash: the types of their columns and sums over them."""
    paths = [scratch_path(spark, "typed"), scratch_path(spark, "typed")]
    fields = {
        "Inteiro": ("event_id", "event_id"),
        "Falta": ("quantidade", "IF(event_id % 10 = 9, NULL, quantidade)"),
        "Misto": ("quantidade", "quantidade + 0.5BD"),
        "Grande": ("event_id", "CONCAT('123456789012345678', event_id + 1000000)"),
        "Texto": ("event_id", "IF(event_id % 3 = 0, 'x', CAST(event_id AS STRING))"),
        "Logico": ("event_id % 4 = 0", "event_id % 6 = 0"),
        "Talvez": ("event_id % 4 = 0", "IF(event_id % 6 = 1, NULL, event_id % 6 = 0)"),
        "Vazio": ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)"),
        "Data": ("DATE_FORMAT(data, 'M/d/yyyy')", "DATE_FORMAT(data, 'MM/dd/yyyy')"),
    }
    for odd, path in enumerate(paths):
        half = ledger(spark, folder).where(f"event_id % 2 = {odd}")
        write_export(half.selectExpr(*[f"{f[odd]} AS {name}" for name, f in fields.items()]), path)
    read = read_export(spark, paths, infer=True)
    counted = read.agg(
        *[F.count(n).alias(f"{n}_n") for n in read.columns],
        *[F.max(n).cast("string").alias(f"{n}_max") for n in read.columns],
    )
    rows = ", ".join(f"'{n}', '{kind}', {n}_n, {n}_max" for n, kind in read.dtypes)
    return counted.selectExpr(f"STACK({len(fields)}, {rows}) AS (coluna, tipo, presentes, maior)")


def queries() -> dict[str, Query]:
    one = {
        # rows
        "closed_trades": lambda s, f: cleaning.closed_trades(ledger(s, f)),
        "duration_cap": lambda s, f: cleaning.duration_cap(ledger(s, f)),
        "side_inversion": lambda s, f: ledger(s, f).selectExpr(
            "event_id", f"{cleaning.INVERTED_SIDE} AS lado"
        ),
        "value_per_contract": lambda s, f: ledger(s, f).selectExpr(
            "event_id", f"{cleaning.VALUE_PER_CONTRACT} AS {st.PER_CONTRACT}"
        ),
        "value_per_share": lambda s, f: ledger(s, f).selectExpr(
            "event_id", f"{cleaning.VALUE_PER_SHARE} AS {st.PER_SHARE}"
        ),
        "outcome_sign": lambda s, f: ledger(s, f).selectExpr(
            "event_id", f"{cleaning.OUTCOME_SIGN} AS ranking"
        ),
        "cleaned_ledger": trades,
        "ticker_root": lambda s, f: ledger(s, f).selectExpr(
            "event_id", f"{ticker_root()} AS codigo"
        ),
        "ticker_root_futures": lambda s, f: st.select_strategy(trades(s, f), st.X_SALADA).selectExpr(
            "event_id", f"{three_letter_root()} AS codigo"
        ),
        "date_bounds": lambda s, f: selection.date_bounds(trades(s, f)),
        "date_range": lambda s, f: ledger_in_range(trades(s, f), *RANGE),
        "month_filter": lambda s, f: selection.month_filter(trades(s, f), MONTH),
        "strategy_tags": lambda s, f: st.strategy_tags(in_range(s, f)).select(
            "event_id", "ordem"
        ),
        # per ticker and trader
        "total_por_ativo": lambda s, f: measures.total_by_ticker(
            _summary(s, f, st.OVERVIEW), st.OVERVIEW
        ),
        "total_operador_abertura": _by_trader(st.ABERTURA_FUTUROS),
        "total_operador_tarde": _by_trader(st.FUTUROS_TARDE),
        "winners": lambda s, f: measures.winners(_summary(s, f, CARDS), CARDS),
        "losers_min": lambda s, f: measures.losers(
            _summary(s, f, CONTRACT_CARDS), CONTRACT_CARDS
        ),
        "losers_max": lambda s, f: measures.losers(_summary(s, f, SHARE_CARDS), SHARE_CARDS),
        "mean_value_per_contract": lambda s, f: measures.mean_value_per_contract(_summary(s, f, CONTRACT_CARDS)),
        "mean_value_per_share": lambda s, f: measures.mean_value_per_share(_summary(s, f, SHARE_CARDS)),
        "mean_duration": lambda s, f: measures.mean_duration(_summary(s, f, CARDS), CARDS),
        # the month, contract months kept apart
        "winners_abril": lambda s, f: measures.winners(_month_summary(s, f), CARDS),
        "losers_abril": lambda s, f: measures.losers(_month_summary(s, f), CARDS),
        "running_abril": lambda s, f: month_report(trades(s, f), MONTH).running,
        "total_operador_abril": lambda s, f: month_report(trades(s, f), MONTH).by_trader,
        "total_operador_abertura_por_contrato": _by_trader(st.ABERTURA_FUTUROS, root=False),
        "total_operador_tarde_por_contrato": _by_trader(st.FUTUROS_TARDE, root=False),
        # both openings beside each other
        "scorecards_todas": lambda s, f: measures.scorecards(selection.date_range(trades(s, f)), st.EVERY, with_key=True),
        "acumulado_fracionado": fractional_running,
        "scorecards": lambda s, f: measures.scorecards(selection.date_range(trades(s, f))),
        "scorecard_abril_por_contrato": lambda s, f: month_report(trades(s, f), MONTH).scorecards,
        "scorecard_join": scorecard_join,
        # totals and time
        "strategy_totals": lambda s, f: overview(trades(s, f)).totals,
        "strategy_totals_sem_milho": lambda s, f: month_report(trades(s, f), MONTH).totals,
        "strategy_totals_arredondados": lambda s, f: range_report(trades(s, f), *RANGE).totals,
        "scorecards_periodo": lambda s, f: range_report(trades(s, f), *RANGE).scorecards,
        "headline_currency": headline_currency,
        "daily_cumulative": lambda s, f: overview(trades(s, f)).running,
        # the overview from a stored daily summary
        "resumo_totals": lambda s, f: overview_of_summary(stored_summary(s, f), *RANGE).totals,
        "resumo_totals_paginas": lambda s, f: overview_of_summary(
            stored_summary(s, f), strategies=st.PAGES
        ).totals,
        "resumo_scorecards": lambda s, f: overview_of_summary(stored_summary(s, f), *RANGE).scorecards,
        "resumo_cumulative": lambda s, f: overview_of_summary(
            stored_summary(s, f), *RANGE
        ).running,
        # profile
        "null_profile": lambda s, f: profile.null_profile(ledger(s, f)),
        "ledger_shape": lambda s, f: profile.shape(ledger(s, f)),
        "ledger_dtypes": lambda s, f: profile.column_types(ledger(s, f)),
        "ledger_head": lambda s, f: profile.head(ledger(s, f), order_by="event_id"),
        # storage
        "csv_roundtrip": csv_roundtrip,
        "csv_messy": csv_messy,
        "header_normalisation": header_normalisation,
        "parquet_ledger": parquet_ledger,
        "csv_inferido": csv_inferred,
        # days loaded one after another
        "carga_por_dia": lambda s, f: read_ledger(s, loaded_by_day(s, f)),
        "limites_das_pastas": folder_bounds,
        "perfil_na_carga": profile_in_write,
        "resumo_atualizado_totals": lambda s, f: overview_of_summary(
            read_summary(s, refreshed_summary(s, f)), *RANGE
        ).totals,
        "resumo_atualizado_cumulative": lambda s, f: overview_of_summary(
            read_summary(s, refreshed_summary(s, f))
        ).running,
        "resumo_operador": summary_by_trader,
    }
    per_strategy = {f"rows_{s.key}": _rows_of(s) for s in st.OVERVIEW}
    per_strategy["rows_abertura_futuros_ex_ccm"] = _rows_of(st.ABERTURA_FUTUROS_EX_CCM)
    cards = {f"scorecard_{s.key}": _scorecard(s) for s in CARDS}
    cards["scorecard_abertura_futuros_ex_ccm"] = _scorecard(st.ABERTURA_FUTUROS_EX_CCM)
    pages = {
        "total_por_ativo_abertura": _by_ticker(st.ABERTURA_FUTUROS_EX_CCM),
        "total_por_ativo_tarde": _by_ticker(st.FUTUROS_TARDE),
        "total_por_ativo_x_salada": _by_ticker(st.X_SALADA),
    }
    return {**one, **per_strategy, **cards, **pages}
