"""The same results as plain SQL, in separate group-bys joined on the ticker.

Nothing here is shared with the Spark side.
"""

from __future__ import annotations

LEDGER_SQL = """
SELECT event_id,
  CASE WHEN MOD(event_id, 79) <> 7 THEN CAST(ts AS DATE)
    + CAST(MOD(event_id, 4) * 30 + CASE WHEN MOD(event_id, 7) = 0 THEN 366 ELSE 0 END AS INT) END AS data,
  CASE WHEN MOD(event_id, 89) <> 3 THEN nome END AS nome,
  CASE WHEN MOD(event_id, 83) <> 5 THEN codigo END AS codigo,
  CASE WHEN MOD(event_id, 71) <> 4 THEN lado END AS lado,
  CAST(CASE WHEN MOD(event_id, 67) = 6 THEN 0 ELSE quantidade END AS BIGINT) AS quantidade,
  CASE WHEN MOD(event_id, 61) = 8 THEN 0.0 ELSE preco END AS preco, bruto, liquido, duracao,
  CASE WHEN MOD(event_id, 73) <> 2 THEN CONCAT(LPAD(CAST(CAST(FLOOR(sod / 3600) AS INT) AS STRING), 2, '0'), ':',
         LPAD(CAST(CAST(FLOOR(MOD(sod, 3600) / 60) AS INT) AS STRING), 2, '0'), ':',
         LPAD(CAST(MOD(sod, 60) AS STRING), 2, '0')) END AS hora
FROM (
  SELECT event_id, ts,
    CONCAT('OP', LPAD(CAST(MOD(user_id, 12) AS STRING), 2, '0')) AS nome,
    CASE MOD(event_id, 16)
      WHEN 0 THEN 'WINJ23' WHEN 1 THEN 'WINM23' WHEN 2 THEN 'WDOJ23' WHEN 3 THEN 'WDOK23'
      WHEN 4 THEN 'DOLK23' WHEN 5 THEN 'INDJ23' WHEN 6 THEN 'CCMK23' WHEN 7 THEN 'CCMU23'
      WHEN 8 THEN 'PETR4' WHEN 9 THEN 'VALE3' WHEN 10 THEN 'ITUB4' WHEN 11 THEN 'BBDC4'
      WHEN 12 THEN 'MGLU3' WHEN 13 THEN 'ABEV3' WHEN 14 THEN 'B3SA3' ELSE 'WEGE3' END AS codigo,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'Compra' ELSE 'Venda' END AS lado,
    CAST(CASE WHEN MOD(event_id, 16) < 8 THEN 1 + MOD(user_id, 5)
              ELSE 100 * (1 + MOD(user_id, 5)) END AS BIGINT) AS quantidade,
    CAST(10 + MOD(event_id * 37, 9000) / CAST(100 AS DOUBLE) AS DOUBLE) AS preco,
    CAST(CASE WHEN MOD(event_id, 13) = 0 THEN 0 ELSE value END AS DOUBLE) AS bruto,
    CAST(CASE WHEN MOD(event_id, 101) = 5 THEN NULL
              WHEN MOD(event_id, 11) = 0 THEN 0
              WHEN MOD(event_id, 16) = 15 THEN value
              WHEN MOD(event_id * 7919 + user_id * 31, 100) < 55 THEN value
              ELSE -value END AS DOUBLE) AS liquido,
    CAST(CASE WHEN MOD(event_id, 103) = 0 THEN 32000
              ELSE MOD(event_id * 31 + user_id * 17, 33000) END AS BIGINT) AS duracao,
    CASE WHEN MOD(event_id, 97) = 0 THEN
           CASE MOD(event_id, 8) WHEN 0 THEN 61200 WHEN 1 THEN 32700 WHEN 2 THEN 61201
             WHEN 3 THEN 36000 WHEN 4 THEN 43200 WHEN 5 THEN 54000 WHEN 6 THEN 32400 ELSE 32701 END
         WHEN MOD(event_id, 5) = 0 THEN 32400 + MOD(event_id, 301)
         ELSE 32400 + MOD(event_id * 7919, 34200) END AS sod
  FROM events
) e
"""

FUT = "('WDO', 'WIN', 'DOL', 'IND')"
DERIV = "('WDO', 'WIN', 'DOL', 'IND', 'CCM')"
ROOT = f"CASE WHEN LEFT(codigo, 3) IN {DERIV} THEN LEFT(codigo, 3) ELSE codigo END"
WHERE = {
    "abertura_futuros": "hora >= '09:00:00' AND hora <= '09:05:00'",
    "abertura_futuros_ex_ccm": (
        "hora >= '09:00:00' AND hora <= '09:05:00' AND LEFT(codigo, 3) <> 'CCM'"
    ),
    "futuros_tarde": (
        f"hora > '09:05:00' AND hora <= '17:00:00' AND LEFT(codigo, 3) IN {FUT}"
    ),
    "abertura_acoes": (
        f"hora >= '10:00:00' AND hora < '12:00:00' AND LEFT(codigo, 3) NOT IN {DERIV}"
    ),
    "leilao": f"hora >= '15:00:00' AND LEFT(codigo, 3) NOT IN {DERIV}",
    "milho": "LEFT(codigo, 3) = 'CCM'",
    "x_salada": f"hora > '17:00:00' AND LEFT(codigo, 3) IN {FUT}",
}
ORDEM = {
    "abertura_futuros": 0, "abertura_futuros_ex_ccm": 0, "futuros_tarde": 1,
    "abertura_acoes": 2, "leilao": 3, "milho": 4, "x_salada": 5,
}
LABEL = {
    "abertura_futuros": "Abertura Futuros", "abertura_futuros_ex_ccm": "Abertura Futuros",
    "futuros_tarde": "Futuros Tarde", "abertura_acoes": "Abertura Ações",
    "leilao": "Leilão", "milho": "Milho", "x_salada": "X salada",
}
SIX = ("abertura_futuros", "futuros_tarde", "abertura_acoes", "leilao", "milho", "x_salada")
FIVE = tuple(k for k in SIX if k != "milho")
CONTRACT = ("abertura_futuros", "futuros_tarde", "x_salada")
SHARE = ("abertura_acoes", "leilao")

RANGE = "data >= DATE '2024-01-20' AND data <= DATE '2025-02-10'"
APRIL = "EXTRACT(month FROM data) = 4"
ANY_DAY = "data IS NOT NULL"

RAW = f"raw AS ({LEDGER_SQL})"
CLOSED = """closed AS (
  SELECT event_id, data, nome, codigo,
    CASE WHEN lado = 'Venda' THEN 'Compra' ELSE 'Venda' END AS lado,
    quantidade, preco, bruto, liquido, duracao, hora,
    liquido / NULLIF(quantidade, 0) AS valor_por_contrato,
    CAST(CASE WHEN liquido > 0 THEN 1 WHEN liquido < 0 THEN -1 ELSE 0 END AS INT) AS ranking,
    liquido / NULLIF(preco * quantidade, 0) AS valor_por_acao
  FROM raw
  WHERE liquido IS DISTINCT FROM 0 AND bruto IS DISTINCT FROM 0 AND duracao < 32000)"""


def on_raw(select: str) -> str:
    return f"WITH {RAW} {select}"


def on_closed(select: str) -> str:
    return f"WITH {RAW}, {CLOSED} {select}"


def on_chosen(select: str, days: str = ANY_DAY, rooted: bool = True) -> str:
    """Over ``t``: closed trades of some days, with rooted tickers or not."""
    codigo = ROOT if rooted else "codigo"
    chosen = f"t AS (SELECT * REPLACE ({codigo} AS codigo) FROM closed WHERE {days})"
    return f"WITH {RAW}, {CLOSED}, {chosen} {select}"


def r2(x: str) -> str:
    return f"round_even(({x}) * 100, 0) / 100"


def money(x: str = "liquido") -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(38,12))) AS DOUBLE), 0.0)"


def maybe_r2(x: str, condition: bool) -> str:
    return r2(x) if condition else x


def total_part(key: str) -> str:
    return (
        f"SELECT codigo, {maybe_r2(money(), key == 'futuros_tarde' or key in SHARE)} AS liquido "
        f"FROM t WHERE {WHERE[key]} AND codigo IS NOT NULL GROUP BY codigo"
    )


def winners_part(key: str) -> str:
    mean, best = f"{money()} / COUNT(liquido)", "MAX(liquido)"
    return (
        f"SELECT codigo, {maybe_r2(mean, key in SHARE)} AS media_melhores, "
        f"COUNT(liquido) AS qtd_melhores, {maybe_r2(best, key in SHARE)} AS melhor "
        f"FROM t WHERE {WHERE[key]} AND liquido > 0 AND codigo IS NOT NULL GROUP BY codigo"
    )


def losers_part(key: str) -> str:
    mean = f"{money()} / COUNT(liquido)"
    worst = "MAX(liquido)" if key in SHARE else "MIN(liquido)"
    return (
        f"SELECT codigo, {maybe_r2(mean, key in SHARE)} AS media_piores, "
        f"COUNT(liquido) AS qtd_piores, {maybe_r2(worst, key in SHARE)} AS pior "
        f"FROM t WHERE {WHERE[key]} AND liquido < 0 AND codigo IS NOT NULL GROUP BY codigo"
    )


# Ratios in whole multiples of 2^-62, whose sum is exact; by way of text it becomes the nearest double.
UNIT = "4611686018427387904"


def exact_mean(x: str) -> str:
    total = f"SUM(CAST(ROUND_EVEN({x} * CAST({UNIT} AS DOUBLE), 0) AS HUGEINT))"
    return f"CAST(CAST({total} AS VARCHAR) AS DOUBLE) / CAST({UNIT} AS DOUBLE) / COUNT({x})"


def unit_part(key: str) -> str:
    if key in SHARE:
        value, name = f"{exact_mean('valor_por_acao')} * 100", "valor_por_acao"
    else:
        value, name = exact_mean("valor_por_contrato"), "valor_por_contrato"
    return f"SELECT codigo, {value} AS {name} FROM t WHERE {WHERE[key]} AND codigo IS NOT NULL GROUP BY codigo"


def duration_part(key: str) -> str:
    mean = "CAST(SUM(duracao) AS DOUBLE) / COUNT(duracao)"
    rounded = key in SHARE or key.startswith("abertura_futuros")
    return (
        f"SELECT codigo, {maybe_r2(mean, rounded)} AS duracao "
        f"FROM t WHERE {WHERE[key]} AND codigo IS NOT NULL GROUP BY codigo"
    )


def card(key: str, rooted: bool = True) -> str:
    unit = "valor_por_acao" if key in SHARE else "valor_por_contrato"
    sql = (
        "SELECT codigo, liquido, media_melhores, qtd_melhores, melhor, media_piores, qtd_piores, "
        f"pior, {unit}, duracao, "
        f"{r2('CAST(qtd_melhores AS DOUBLE) / (qtd_melhores + qtd_piores)')} AS pct_vencedoras "
        f"FROM ({total_part(key)}) a JOIN ({winners_part(key)}) b USING (codigo) "
        f"JOIN ({losers_part(key)}) c USING (codigo) JOIN ({unit_part(key)}) d USING (codigo) "
        f"JOIN ({duration_part(key)}) e USING (codigo)"
    )
    if key == "x_salada" and not rooted:
        sql = sql.replace("FROM t WHERE", "FROM t_root WHERE")
    return sql


def numbered(part, keys) -> str:
    """One part per strategy, stacked under its number."""
    return " UNION ALL ".join(
        f"SELECT CAST({ORDEM[k]} AS INT) AS ordem, p.* FROM ({part(k)}) p" for k in keys
    )


def all_cards(rooted: bool = True) -> str:
    both = {
        True: "valor_por_contrato, CAST(NULL AS DOUBLE) AS valor_por_acao",
        False: "CAST(NULL AS DOUBLE) AS valor_por_contrato, valor_por_acao",
    }
    return " UNION ALL ".join(
        f"SELECT CAST({ORDEM[k]} AS INT) AS ordem, codigo, liquido, media_melhores, "
        "qtd_melhores, melhor, media_piores, qtd_piores, pior, "
        f"{both[k in CONTRACT]}, duracao, pct_vencedoras FROM ({card(k, rooted)}) c"
        for k in FIVE
    )


def keyed_cards(keys) -> str:
    stacked = []
    for k in keys:
        units = ["valor_por_contrato", "CAST(NULL AS DOUBLE) AS valor_por_acao"]
        if k in SHARE:
            units = ["CAST(NULL AS DOUBLE) AS valor_por_contrato", "valor_por_acao"]
        stacked.append(
            f"SELECT '{k}' AS chave, CAST({ORDEM[k]} AS INT) AS ordem, codigo, liquido, "
            "media_melhores, qtd_melhores, melhor, media_piores, qtd_piores, pior, "
            f"{', '.join(units)}, duracao, pct_vencedoras FROM ({card(k)}) c"
        )
    return " UNION ALL ".join(stacked)


def trader_part(key: str) -> str:
    return (
        f"SELECT nome, codigo, {money()} AS liquido FROM t WHERE {WHERE[key]} "
        "AND nome IS NOT NULL AND codigo IS NOT NULL GROUP BY nome, codigo"
    )


def month_part(part):
    """A part over the month, where only X Salada has its tickers rooted."""

    def over(key: str) -> str:
        sql = part(key)
        return sql.replace("FROM t WHERE", "FROM t_root WHERE") if key == "x_salada" else sql

    return over


def totals(keys, all_rounded: bool = False) -> str:
    rows = []
    for k in keys:
        if k == "futuros_tarde":
            per_ticker = f"SELECT {r2(money())} AS v FROM t WHERE {WHERE[k]} GROUP BY codigo"
            value = f"(SELECT {money('v')} FROM ({per_ticker}) x)"
        else:
            value = f"(SELECT {money()} FROM t WHERE {WHERE[k]})"
        if all_rounded or k in ("abertura_futuros", "abertura_futuros_ex_ccm", "milho"):
            value = r2(value)
        rows.append(
            f"SELECT CAST({ORDEM[k]} AS INT) AS ordem, '{LABEL[k]}' AS estrategia, "
            f"{value} AS resultado"
        )
    return " UNION ALL ".join(rows)


CUMULATIVE = """SELECT data, CAST(liq AS DOUBLE) AS liquido,
  CAST(SUM(liq) OVER (ORDER BY data) AS DOUBLE) AS acumulado
FROM (SELECT data, COALESCE(SUM(CAST(liquido AS DECIMAL(38,12))), 0) AS liq
      FROM t GROUP BY data) d"""
FRACTIONAL = CUMULATIVE.replace("CAST(liquido AS", "CAST(liquido * 1e-6 AS")

COLUMN_TYPES = {
    "event_id": "bigint", "data": "date", "nome": "string", "codigo": "string",
    "lado": "string", "quantidade": "bigint", "preco": "double", "bruto": "double",
    "liquido": "double", "duracao": "bigint", "hora": "string",
}
TRADE_ROW = "event_id, data, hora, codigo, liquido"
EXPORT_EXTRA = (
    "CAST(data AS VARCHAR) || ' ' || hora AS datahora, "
    "'Operação de ' || lado AS \"descrição_operação\""
)


_SECOND = "MOD(event_id, 2) = 1"
INFERRED = [
    f"SELECT '{name}' AS coluna, '{kind}' AS tipo, COUNT(v) AS presentes, {biggest} AS maior FROM (SELECT *, {value} AS v FROM raw) x"
    for name, kind, value, biggest in (
        ("inteiro", "bigint", "event_id", "CAST(MAX(v) AS VARCHAR)"),
        ("falta", "double", f"CASE WHEN NOT ({_SECOND} AND MOD(event_id, 10) = 9) THEN quantidade END", "CAST(CAST(MAX(v) AS DOUBLE) AS VARCHAR)"),
        ("misto", "double", f"quantidade + CASE WHEN {_SECOND} THEN 0.5 ELSE 0 END", "CAST(CAST(MAX(v) AS DOUBLE) AS VARCHAR)"),
        ("grande", "string", f"CASE WHEN {_SECOND} THEN '123456789012345678' || (event_id + 1000000) ELSE CAST(event_id AS VARCHAR) END", "MAX(v)"),
        ("texto", "string", f"CASE WHEN {_SECOND} AND MOD(event_id, 3) = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END", "MAX(v)"),
        ("logico", "boolean", f"CASE WHEN {_SECOND} THEN MOD(event_id, 6) = 0 ELSE MOD(event_id, 4) = 0 END", "CAST(MAX(v) AS VARCHAR)"),
        (
            "talvez", "string",
            f"CASE WHEN NOT {_SECOND} THEN CAST(MOD(event_id, 4) = 0 AS VARCHAR) WHEN MOD(event_id, 6) <> 1 THEN CAST(MOD(event_id, 6) = 0 AS VARCHAR) END",
            "MAX(v)",
        ),
        ("vazio", "double", "NULL", "CAST(NULL AS VARCHAR)"),
        ("data", "date", "data", "CAST(MAX(v) AS VARCHAR)"),
    )
]


def union_all(rows) -> str:
    return " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    one = {
        "closed_trades": on_raw(
            "SELECT * FROM raw WHERE liquido IS DISTINCT FROM 0 AND bruto IS DISTINCT FROM 0"
        ),
        "duration_cap": on_raw("SELECT * FROM raw WHERE duracao < 32000"),
        "side_inversion": on_raw(
            "SELECT event_id, CASE lado WHEN 'Venda' THEN 'Compra' ELSE 'Venda' END AS lado "
            "FROM raw"
        ),
        "value_per_contract": on_raw(
            "SELECT event_id, liquido / NULLIF(quantidade, 0) AS valor_por_contrato FROM raw"
        ),
        "value_per_share": on_raw(
            "SELECT event_id, liquido / NULLIF(preco * quantidade, 0) AS valor_por_acao FROM raw"
        ),
        "outcome_sign": on_raw(
            "SELECT event_id, CAST(COALESCE(SIGN(liquido), 0) AS INT) AS ranking FROM raw"
        ),
        "cleaned_ledger": on_closed("SELECT * FROM closed"),
        "ticker_root": on_raw(f"SELECT event_id, {ROOT} AS codigo FROM raw"),
        "ticker_root_futures": on_closed(
            "SELECT event_id, LEFT(codigo, 3) AS codigo FROM closed "
            f"WHERE {WHERE['x_salada']}"
        ),
        "date_bounds": on_closed(
            "SELECT MIN(data) AS data_min, MAX(data) AS data_max FROM closed"
        ),
        "date_range": on_chosen("SELECT * FROM t", RANGE),
        "month_filter": on_closed(f"SELECT * FROM closed WHERE {APRIL}"),
        "strategy_tags": on_chosen(
            union_all(
                f"SELECT event_id, CAST({ORDEM[k]} AS INT) AS ordem FROM t WHERE {WHERE[k]}"
                for k in SIX
            )
        ),
        "total_por_ativo": on_chosen(numbered(total_part, SIX)),
        "winners": on_chosen(numbered(winners_part, FIVE)),
        "losers_min": on_chosen(numbered(losers_part, CONTRACT)),
        "losers_max": on_chosen(numbered(losers_part, SHARE)),
        "mean_value_per_contract": on_chosen(numbered(unit_part, CONTRACT)),
        "mean_value_per_share": on_chosen(numbered(unit_part, SHARE)),
        "mean_duration": on_chosen(numbered(duration_part, FIVE)),
        "scorecards": on_chosen(all_cards()),
        "scorecard_join": on_chosen(card("leilao")),
        "strategy_totals": on_chosen(totals(SIX)),
        "strategy_totals_sem_milho": on_chosen(totals(FIVE), APRIL, rooted=False),
        "strategy_totals_arredondados": on_chosen(totals(FIVE, all_rounded=True), RANGE),
        "scorecards_periodo": on_chosen(all_cards(), RANGE),
        "headline_currency": on_chosen(
            "SELECT estrategia, format('R$ {:,.2f}', resultado) AS resultado FROM "
            f"({totals(('abertura_futuros_ex_ccm', 'futuros_tarde', 'x_salada'))}) h"
        ),
        "daily_cumulative": on_chosen(CUMULATIVE),
        "resumo_totals": on_chosen(totals(SIX), RANGE),
        "resumo_totals_paginas": on_chosen(totals(("abertura_futuros_ex_ccm", *SIX[1:]))),
        "resumo_scorecards": on_chosen(all_cards(), RANGE),
        "resumo_cumulative": on_chosen(CUMULATIVE, RANGE),
        "null_profile": on_raw(
            union_all(
                f"SELECT '{c}' AS coluna, COUNT(*) - COUNT({c}) AS nulos FROM raw"
                for c in COLUMN_TYPES
            )
        ),
        "ledger_shape": on_raw(
            f"SELECT COUNT(*) AS linhas, CAST({len(COLUMN_TYPES)} AS INT) AS colunas FROM raw"
        ),
        "ledger_dtypes": on_raw(
            union_all(
                f"SELECT '{c}' AS coluna, '{kind}' AS tipo, COUNT({c}) AS presentes FROM raw"
                for c, kind in COLUMN_TYPES.items()
            )
        ),
        "ledger_head": on_raw("SELECT * FROM raw ORDER BY event_id LIMIT 5"),
        "csv_roundtrip": (
            f"WITH {RAW}, {CLOSED} SELECT c.*, x.datahora, x.\"descrição_operação\" FROM closed c "
            f"JOIN (SELECT event_id, {EXPORT_EXTRA} FROM raw) x USING (event_id)"
        ),
        "header_normalisation": on_raw(f"SELECT *, {EXPORT_EXTRA} FROM raw"),
        "parquet_ledger": on_closed(f"SELECT * FROM closed WHERE {RANGE}"),
        "carga_por_dia": on_closed("SELECT * FROM closed"),
        "limites_das_pastas": on_closed("SELECT MIN(data) AS data_min, MAX(data) AS data_max FROM closed"),
        "perfil_na_carga": on_raw(
            union_all(
                f"SELECT '{c}' AS coluna, '{kind}' AS tipo, COUNT({c}) AS presentes, COUNT(*) - COUNT({c}) AS nulos, "
                f"COUNT(*) AS linhas, CAST({len(COLUMN_TYPES)} AS INT) AS colunas FROM raw"
                for c, kind in COLUMN_TYPES.items()
            )
        ),
        "resumo_atualizado_totals": on_chosen(totals(SIX), RANGE),
        "resumo_atualizado_cumulative": on_chosen(CUMULATIVE),
        "resumo_operador": on_chosen(numbered(trader_part, FIVE), RANGE),
        "csv_inferido": on_raw(union_all(INFERRED)),
        "total_por_ativo_abertura": on_chosen(total_part("abertura_futuros_ex_ccm")),
        "total_por_ativo_tarde": on_chosen(total_part("futuros_tarde")),
        "total_por_ativo_x_salada": on_chosen(total_part("x_salada")),
    }
    one["scorecards_todas"] = on_chosen(keyed_cards((*FIVE, "abertura_futuros_ex_ccm")))
    one["acumulado_fracionado"] = on_chosen(
        f"SELECT data, ROUND(liquido, 9) AS liquido, ROUND(acumulado, 9) AS acumulado FROM ({FRACTIONAL}) f"
    )
    one["running_abril"] = on_chosen(CUMULATIVE, APRIL, rooted=False)
    one["csv_messy"] = on_raw(
        "SELECT event_id, data, CAST(data AS VARCHAR) || ' ' || LEFT(hora, 5) || ':00' AS datahora, codigo, "
        "quantidade, liquido, 'lado \"' || lado || '\", ' || hora AS nota FROM raw"
    )
    rooted_x = f"t_root AS (SELECT * REPLACE ({ROOT} AS codigo) FROM t)"
    one["scorecard_abril_por_contrato"] = (
        f"WITH {RAW}, {CLOSED}, t AS (SELECT * FROM closed WHERE {APRIL}), {rooted_x} "
        f"{all_cards(rooted=False)}"
    )
    in_month = f"WITH {RAW}, {CLOSED}, t AS (SELECT * FROM closed WHERE {APRIL}), {rooted_x} "
    one["winners_abril"] = in_month + numbered(month_part(winners_part), FIVE)
    one["losers_abril"] = in_month + numbered(month_part(losers_part), FIVE)
    one["total_operador_abril"] = in_month + numbered(month_part(trader_part), FIVE)
    for key, strategy in (("abertura", "abertura_futuros"), ("tarde", "futuros_tarde")):
        one[f"total_operador_{key}"] = on_chosen(trader_part(strategy))
        one[f"total_operador_{key}_por_contrato"] = on_chosen(trader_part(strategy), rooted=False)
    rows = {f"rows_{k}": on_chosen(f"SELECT {TRADE_ROW} FROM t WHERE {w}") for k, w in WHERE.items()}
    cards = {f"scorecard_{k}": on_chosen(card(k)) for k in WHERE if k != "milho"}
    return {**one, **rows, **cards}
