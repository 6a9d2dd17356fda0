"""Win and loss measures per ticker.

Every table here is a projection of one summary: a single hash aggregate with
conditional sums, counts and extremes. All of them combine on the map side, so
what is shuffled grows with tickers and tasks, not with trades, and a ticker
that holds a third of the ledger costs no more than any other. A summary can be
summed again over fewer keys, so one per day serves every later date choice.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.functions import (
    exact_sum,
    from_exact,
    money_decimals,
    money_sum,
    round2,
    three_letter_root,
    ticker_root,
)
from pregao.operators.strategies import (
    EVERY,
    OVERVIEW,
    PER_CONTRACT,
    PER_SHARE,
    ROUNDED,
    SUM_OF_ROUNDED,
    Strategies,
    Strategy,
    distinct,
    fan_out,
    tags,
    with_scorecard,
)

_SUMS = (
    "ganhos", "perdas", "qtd_melhores", "qtd_piores", "contrato_soma", "contrato_qtd",
    "acao_soma", "acao_qtd", "duracao_soma", "duracao_qtd",
)
_MAXIMA = ("melhor", "perda_max")
_MINIMA = ("perda_min",)


def _aggregate(df: DataFrame, keys: Iterable[str | Column], measures: dict[str, str]) -> DataFrame:
    keyed = [F.expr(key) if isinstance(key, str) else key for key in keys]
    return df.groupBy(*keyed).agg(*[F.expr(m).alias(name) for name, m in measures.items()])


def summarise(trades: DataFrame, *keys: str | Column) -> DataFrame:
    """All partial measures of cleaned trades, per ``keys``."""
    decimals = money_decimals(trades)
    if isinstance(trades.schema["duracao"].dataType, T.IntegralType):
        duration = "CAST(COALESCE(SUM(duracao), 0) AS DECIMAL(20,0))"
    else:
        duration = money_sum("duracao", decimals)
    win, loss = "FILTER (WHERE liquido > 0)", "FILTER (WHERE liquido < 0)"
    measures = {
        "ganhos": money_sum("liquido", decimals, win),
        "perdas": money_sum("liquido", decimals, loss),
        "qtd_melhores": f"COUNT(*) {win}",
        "qtd_piores": f"COUNT(*) {loss}",
        "melhor": f"MAX(liquido) {win}",
        "perda_max": f"MAX(liquido) {loss}",
        "perda_min": f"MIN(liquido) {loss}",
        "contrato_soma": exact_sum("valor_por_contrato"),
        "contrato_qtd": "COUNT(valor_por_contrato)",
        "acao_soma": exact_sum("valor_por_acao"),
        "acao_qtd": "COUNT(valor_por_acao)",
        "duracao_soma": duration,
        "duracao_qtd": "COUNT(duracao)",
    }
    return _aggregate(trades, keys, measures)


_MERGED = {c: f"{rule}({c})" for rule, cs in (("SUM", _SUMS), ("MAX", _MAXIMA), ("MIN", _MINIMA)) for c in cs}


def merge(summary: DataFrame, *keys: str) -> DataFrame:
    """Sum a summary up to fewer keys."""
    return _aggregate(summary, keys, _MERGED)


def daily_summary(trades: DataFrame, strategies: Strategies = EVERY) -> DataFrame:
    """A summary per day, ticker and set of strategies.

    Kept as a table, it answers every date choice and every selection of these
    strategies without another pass over the trades; trades in no strategy are
    in it for the daily totals.
    """
    return summarise(trades, "data", "codigo", tags(strategies))


BY_TICKER, BY_TRADER = "ativo", "operador"
GRAINS = (BY_TICKER, BY_TRADER)


def two_grain_summary(trades: DataFrame, strategies: Strategies = EVERY) -> DataFrame:
    """The daily summary and, beside it, one per trader as well, told apart by ``grao``.

    One pass over the trades gives the finer one; both come from its few rows by grouping
    sets. Reports per ticker read the coarse rows only, which a room full of traders
    does not make more of.
    """
    keys = ["data", "nome", "codigo", "tags"]
    fine = summarise(trades, "data", "nome", "codigo", tags(strategies))
    sets = [["data", "codigo", "tags"], keys]
    measures = [F.expr(m).alias(name) for name, m in _MERGED.items()]
    both = fine.groupingSets(sets, *keys).agg(F.grouping("nome").alias("_rolled"), *measures)
    grain = F.when(F.col("_rolled") == 1, BY_TICKER).otherwise(BY_TRADER).alias("grao")
    # The tests that the bits stand for are the column's metadata, which grouping sets drop.
    tagged = F.col("tags").alias("tags", metadata=fine.schema["tags"].metadata)
    return both.select(grain, "data", "nome", "codigo", tagged, *_MERGED)


def per_strategy(
    trades: DataFrame, strategies: Strategies = OVERVIEW, root: bool = True
) -> DataFrame:
    """The summary per strategy and ticker, for all strategies in one pass."""
    summary = summarise(trades, "codigo", tags(strategies))
    return per_strategy_of_summary(summary, strategies, root)


def per_strategy_of_summary(
    summary: DataFrame, strategies: Strategies = OVERVIEW, root: bool = True
) -> DataFrame:
    ticker = _ticker_within(strategies, root)
    return merge(fan_out(summary, strategies), "chave", "ordem", f"{ticker} AS codigo")


def of_strategy(trades: DataFrame, strategy: Strategy, root: bool = True) -> DataFrame:
    """The summary per ticker of one strategy.

    Tickers are rooted after the filter, so the filter on the stored ticker and
    time reaches the scan.
    """
    chosen = trades.where(strategy.matches())
    return of_strategy_summary(summarise(chosen, "codigo"), strategy, root)


def of_strategy_summary(summary: DataFrame, strategy: Strategy, root: bool = True) -> DataFrame:
    """The summary per ticker, given one of only this strategy's trades by stored ticker and more."""
    per_ticker = merge(summary, f"{_ticker(strategy, root)} AS codigo")
    return per_ticker.selectExpr(f"'{strategy.key}' AS chave", f"{strategy.ordem} AS ordem", "*")


def _ticker(strategy: Strategy, root: bool) -> str:
    if root:
        return ticker_root()
    return three_letter_root() if strategy.always_rooted else "codigo"


def _ticker_within(strategies: Strategies, root: bool) -> str:
    if root:
        return ticker_root()
    rooted = _within(s for s in strategies if s.always_rooted)
    return f"IF({rooted}, {three_letter_root()}, codigo)"


def _within(strategies: Iterable[Strategy]) -> str:
    """Whether the strategy of a row is one of these."""
    listed = ", ".join(f"'{s.key}'" for s in strategies)
    return f"chave IN ({listed})" if listed else "FALSE"


# --- tables per strategy and ticker -------------------------------------------------------

# Wins and losses are all there is to a net result.
_TOTAL = "CAST(ganhos + perdas AS DOUBLE)"
_UNITS = {
    PER_CONTRACT: f"TRY_DIVIDE({from_exact('contrato_soma')}, contrato_qtd)",
    # in percent
    PER_SHARE: f"TRY_DIVIDE({from_exact('acao_soma')}, acao_qtd) * 100",
}
# Winning share of the decided trades, as a fraction.
_HIT_RATE = (
    round2("TRY_DIVIDE(qtd_melhores, qtd_melhores + qtd_piores)") + " AS pct_vencedoras"
)


def _mean(total: str, count: str) -> str:
    return f"TRY_DIVIDE(CAST({total} AS DOUBLE), {count})"


def _shown(strategies: Strategies, name: str, value: str) -> str:
    """``value`` with two decimals for the strategies that show it so."""
    rounded = [s for s in strategies if name in s.rounded]
    if not rounded:
        return f"{value} AS {name}"
    if len(rounded) == len(strategies):
        return f"{round2(value)} AS {name}"
    return f"IF({_within(rounded)}, {round2(value)}, {value}) AS {name}"


def _total_column(strategies: Strategies) -> str:
    return _shown(strategies, "liquido", _TOTAL)


def _win_columns(strategies: Strategies) -> list[str]:
    return [
        _shown(strategies, "media_melhores", _mean("ganhos", "qtd_melhores")),
        "qtd_melhores",
        _shown(strategies, "melhor", "melhor"),
    ]


def _loss_columns(strategies: Strategies) -> list[str]:
    smallest = _within(s for s in strategies if s.worst == "max")
    return [
        _shown(strategies, "media_piores", _mean("perdas", "qtd_piores")),
        "qtd_piores",
        _shown(strategies, "pior", f"IF({smallest}, perda_max, perda_min)"),
    ]


def _duration_column(strategies: Strategies) -> str:
    return _shown(strategies, "duracao", _mean("duracao_soma", "duracao_qtd"))


def _part(
    summary: DataFrame, columns: Iterable[str], test: str = "TRUE", with_key: bool = False
) -> DataFrame:
    kept = summary.where(f"codigo IS NOT NULL AND {test}")
    return kept.selectExpr(*["chave"] * with_key, "ordem", "codigo", *columns)


def total_by_ticker(summary: DataFrame, strategies: Strategies) -> DataFrame:
    return _part(summary, [_total_column(distinct(strategies, "ordem"))])


def winners(summary: DataFrame, strategies: Strategies) -> DataFrame:
    """Mean, count and best of the winning trades; tickers without one are absent."""
    return _part(summary, _win_columns(distinct(strategies, "ordem")), "qtd_melhores > 0")


def losers(summary: DataFrame, strategies: Strategies) -> DataFrame:
    """Mean, count and worst of the losing trades; tickers without one are absent."""
    return _part(summary, _loss_columns(distinct(strategies, "ordem")), "qtd_piores > 0")


def mean_value_per_contract(summary: DataFrame) -> DataFrame:
    """Mean result per contract, by ticker."""
    means = _part(summary, [f"{_UNITS[PER_CONTRACT]} AS {PER_CONTRACT}"])
    return means.orderBy("ordem", "codigo")


def mean_value_per_share(summary: DataFrame) -> DataFrame:
    """Mean return per share traded, in percent, best first."""
    means = _part(summary, [f"{_UNITS[PER_SHARE]} AS {PER_SHARE}"])
    return means.orderBy("ordem", F.desc(PER_SHARE), "codigo")


def mean_duration(summary: DataFrame, strategies: Strategies) -> DataFrame:
    """Mean duration, longest first."""
    means = _part(summary, [_duration_column(distinct(strategies, "ordem"))])
    return means.orderBy("ordem", F.desc("duracao"), "codigo")


# --- scorecards ---------------------------------------------------------------------------


def scorecards_of_summary(
    summary: DataFrame,
    strategies: Strategies,
    require_both_sides: bool = True,
    with_key: bool = False,
) -> DataFrame:
    """Scorecards of every strategy in the summary, in their display order.

    A ticker needs a win and a loss to be listed, unless told otherwise. With
    strategies of both kinds the per-unit column that does not apply is NULL.
    Strategies that share an ``ordem`` need ``with_key``, a column that tells them apart.
    """
    cards = distinct(with_scorecard(strategies), *[] if with_key else ["ordem"])
    tests = [_within(cards)]
    if require_both_sides:
        tests.append("qtd_melhores > 0 AND qtd_piores > 0")
    listed = _part(
        summary,
        [
            _total_column(cards),
            *_win_columns(cards),
            *_loss_columns(cards),
            *_unit_columns(cards),
            _duration_column(cards),
            _HIT_RATE,
            f"IF({_within(s for s in cards if s.by_total)}, -{_TOTAL}, NULL) AS _place",
        ],
        " AND ".join(tests),
        with_key,
    )
    order = ["ordem", *["chave"] * with_key, "_place", "codigo"]
    return listed.orderBy(*order).drop("_place")


def _unit_columns(cards: Strategies) -> list[str]:
    columns = []
    for unit, value in _UNITS.items():
        with_unit = [s for s in cards if s.unit == unit]
        if with_unit:
            applies = len(with_unit) == len(cards)
            shown = value if applies else f"IF({_within(with_unit)}, {value}, NULL)"
            columns.append(f"{shown} AS {unit}")
    return columns


def scorecard(
    trades: DataFrame, strategy: Strategy, root: bool = True, require_both_sides: bool = True
) -> DataFrame:
    """Scorecard of one strategy."""
    summary = of_strategy(trades, strategy, root)
    return scorecards_of_summary(summary, (strategy,), require_both_sides).drop("ordem")


def scorecards(
    trades: DataFrame,
    strategies: Strategies = OVERVIEW,
    root: bool = True,
    with_key: bool = False,
) -> DataFrame:
    """The scorecards of all strategies from one pass over the trades."""
    summary = per_strategy(trades, strategies, root)
    return scorecards_of_summary(summary, strategies, with_key=with_key)


def scorecard_join(
    total: DataFrame, wins: DataFrame, losses: DataFrame, per_unit: DataFrame, duration: DataFrame
) -> DataFrame:
    """The scorecard put together from ready-made part tables.

    ``scorecard`` computes the same in one aggregate and is the way to go on a
    large ledger; this serves tables that already exist.
    """
    joined = total
    for part in (wins, losses, per_unit, duration):
        joined = joined.join(part, ["ordem", "codigo"], "inner")
    return joined.selectExpr("*", _HIT_RATE)


# --- totals -------------------------------------------------------------------------------


def total_by_trader(trades: DataFrame, strategy: Strategy, root: bool = True) -> DataFrame:
    """Net result per trader and ticker within a strategy."""
    summary = summarise(trades.where(strategy.matches()), "nome", "codigo")
    return total_by_trader_of_summary(summary, strategy, root)


def total_by_trader_of_summary(
    summary: DataFrame, strategy: Strategy, root: bool = True
) -> DataFrame:
    """The same, given a summary of only this strategy's trades by trader, stored ticker and more."""
    named = summary.where("nome IS NOT NULL AND codigo IS NOT NULL")
    totals = merge(named, "nome", f"{_ticker(strategy, root)} AS codigo")
    return totals.selectExpr("nome", "codigo", f"{_TOTAL} AS liquido").orderBy("nome", "codigo")


def totals_by_trader_of_summary(
    summary: DataFrame, strategies: Strategies, root: bool = True
) -> DataFrame:
    """Net result per strategy, trader and ticker, from a summary that tags strategies."""
    named = summary.where("nome IS NOT NULL AND codigo IS NOT NULL")
    fanned = fan_out(named, distinct(strategies, "ordem"))
    totals = merge(fanned, "ordem", "nome", f"{_ticker_within(strategies, root)} AS codigo")
    rows = totals.selectExpr("ordem", "nome", "codigo", f"{_TOTAL} AS liquido")
    return rows.orderBy("ordem", "nome", "codigo")


def strategy_totals(
    trades: DataFrame,
    strategies: Strategies = OVERVIEW,
    root: bool = True,
    all_rounded: bool = False,
) -> DataFrame:
    """One row per strategy with its net result, 0.0 for a strategy without trades."""
    return strategy_totals_of_summary(
        per_strategy(trades, strategies, root), strategies, all_rounded
    )


def strategy_totals_of_summary(
    summary: DataFrame, strategies: Strategies, all_rounded: bool = False
) -> DataFrame:
    """A global aggregate with one sum per strategy, turned into rows.

    It has a row even for empty input, so no strategy is lost and no join with
    a list of strategies is needed.
    """
    per_ticker = f"CAST({round2(_TOTAL)} AS DECIMAL(28,2))"
    distinct(strategies, "ordem")
    sums = {}
    for s in strategies:
        amount = per_ticker if s.total == SUM_OF_ROUNDED else "ganhos + perdas"
        own = f"COALESCE(CAST(SUM({amount}) FILTER (WHERE {_within([s])}) AS DOUBLE), 0D)"
        sums[s] = round2(own) if all_rounded or s.total == ROUNDED else own
    totals = summary.agg(*[F.expr(own).alias(f"s{s.ordem}") for s, own in sums.items()])
    rows = ", ".join(
        f"STRUCT({s.ordem} AS ordem, '{s.label}' AS estrategia, s{s.ordem} AS resultado)"
        for s in strategies
    )
    return totals.selectExpr(f"INLINE(ARRAY({rows}))").orderBy("ordem")
