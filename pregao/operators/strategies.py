"""The intraday strategies as data: a time window, a ticker test and report settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pregao.functions import CORN, DERIVATIVES, FUTURES, in_families

ROUNDED, SUM_OF_ROUNDED, RAW = "rounded", "sum of rounded", "raw"
PER_CONTRACT, PER_SHARE = "valor_por_contrato", "valor_por_acao"


@dataclass(frozen=True)
class Strategy:
    ordem: int
    key: str
    label: str
    total: str
    """How the headline total is rounded: the sum, each ticker before summing, or not at all."""
    after: str | None = None
    since: str | None = None
    before: str | None = None
    until: str | None = None
    only: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    unit: str | None = None
    """Per-unit measure of the scorecard; a strategy without one has a total only."""
    worst: str = "min"
    """Which extreme of the losses the scorecard calls the worst."""
    rounded: frozenset[str] = frozenset()
    """Scorecard columns shown with two decimals."""
    by_total: bool = False
    """Scorecard order: best total first instead of by ticker."""
    always_rooted: bool = False
    """Contract months are folded even where the report keeps them apart."""

    def matches(self) -> str:
        """Row predicate. ``hora`` is zero-padded text, so text order is time order."""
        tests = [
            f"hora {sign} '{time}'"
            for sign, time in (
                (">=", self.since), (">", self.after), ("<=", self.until), ("<", self.before)
            )
            if time
        ]
        if self.only:
            tests.append(in_families(self.only))
        if self.without:
            tests.append(f"NOT {in_families(self.without)}")
        return " AND ".join(tests)


_SHARE_CARD = {
    "unit": PER_SHARE,
    "worst": "max",
    "rounded": frozenset(
        ("liquido", "media_melhores", "melhor", "media_piores", "pior", "duracao")
    ),
    "by_total": True,
}

# Windows, families, labels and display rules of the strategies.
ABERTURA_FUTUROS = Strategy(
    0, "abertura_futuros", "Abertura Futuros", ROUNDED,
    since="09:00:00", until="09:05:00",
    unit=PER_CONTRACT, rounded=frozenset(["duracao"]),
)
FUTUROS_TARDE = Strategy(
    1, "futuros_tarde", "Futuros Tarde", SUM_OF_ROUNDED,
    after="09:05:00", until="17:00:00", only=FUTURES,
    unit=PER_CONTRACT, rounded=frozenset(["liquido"]),
)
ABERTURA_ACOES = Strategy(
    2, "abertura_acoes", "Abertura Ações", RAW,
    since="10:00:00", before="12:00:00", without=DERIVATIVES, **_SHARE_CARD,
)
LEILAO = Strategy(
    3, "leilao", "Leilão", RAW,
    since="15:00:00", without=DERIVATIVES, **_SHARE_CARD,
)
MILHO = Strategy(4, "milho", "Milho", ROUNDED, only=CORN)
X_SALADA = Strategy(
    5, "x_salada", "X salada", RAW,
    after="17:00:00", only=FUTURES,
    unit=PER_CONTRACT, always_rooted=True,
)
# The strategy pages leave corn out of the opening; the overview does not.
ABERTURA_FUTUROS_EX_CCM = replace(ABERTURA_FUTUROS, key="abertura_futuros_ex_ccm", without=CORN)

OVERVIEW = (ABERTURA_FUTUROS, FUTUROS_TARDE, ABERTURA_ACOES, LEILAO, MILHO, X_SALADA)
PAGES = (ABERTURA_FUTUROS_EX_CCM, *OVERVIEW[1:])
EVERY = (*OVERVIEW, ABERTURA_FUTUROS_EX_CCM)
WITHOUT_CORN = tuple(s for s in OVERVIEW if s is not MILHO)


def with_scorecard(strategies: tuple[Strategy, ...]) -> tuple[Strategy, ...]:
    return tuple(s for s in strategies if s.unit)


def select_strategy(df: DataFrame, strategy: Strategy) -> DataFrame:
    """Trades of one strategy. Works on raw and on rooted tickers."""
    return df.where(strategy.matches())


Strategies = tuple[Strategy, ...]
# Metadata of a tag column: the tests its bits stand for, lowest first.
_TESTS = "strategy_tests"


def distinct(strategies: Strategies, *attributes: str) -> Strategies:
    """The same strategies, or an error if two of them share one of these attributes."""
    for name in ("key", *attributes):
        values = [getattr(s, name) for s in strategies]
        if len(set(values)) < len(values):
            raise ValueError(f"strategies that share a {name} cannot be told apart: {values}")
    return strategies


def tags(strategies: Strategies) -> Column:
    """All strategies of a trade as one integer, ``tags``, with a bit per strategy.

    Strategies overlap, and a bit set lets a trade belong to several without
    being copied: rows are aggregated first and fanned out afterwards. The column
    carries which test each bit stands for, also into a stored table.
    """
    tests = [s.matches() for s in distinct(strategies)]
    bits = " | ".join(f"IF({test}, {1 << i}, 0)" for i, test in enumerate(tests)) or "0"
    return F.expr(bits).alias("tags", metadata={_TESTS: tests})


def known_tests(df: DataFrame) -> list[str] | None:
    """The tests that the bits of ``tags`` stand for."""
    return df.schema["tags"].metadata.get(_TESTS)


def fan_out(df: DataFrame, strategies: Strategies) -> DataFrame:
    """One row per strategy in the bit set ``tags``, as columns ``chave`` and ``ordem``.

    Strategies that the bits do not stand for are refused.
    """
    known = known_tests(df)
    if known is None:
        raise ValueError("the tags column does not say which strategies it stands for")
    unknown = [s.key for s in distinct(strategies) if s.matches() not in known]
    if unknown:
        raise ValueError(f"the summary was not made for these strategies: {unknown}")
    slots = ", ".join(
        f"IF(tags & {1 << known.index(s.matches())} != 0, "
        f"STRUCT('{s.key}' AS chave, {s.ordem} AS ordem), NULL)"
        for s in strategies
    )
    others = [c for c in df.columns if c != "tags"]
    fanned = df.selectExpr(*others, f"EXPLODE(ARRAY({slots})) AS s").where("s IS NOT NULL")
    return fanned.selectExpr("s.chave", "s.ordem", *others)


def strategy_tags(df: DataFrame, strategies: Strategies = OVERVIEW) -> DataFrame:
    """One row per trade and strategy it belongs to."""
    return fan_out(df.select("*", tags(strategies)), strategies)
