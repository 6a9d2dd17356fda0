"""Numeric expressions: rounding, NaN handling and exact money sums."""

from __future__ import annotations

from pyspark.sql import DataFrame

MONEY_DECIMALS_SETTING = "spark.pregao.moneyDecimals"
MONEY_DECIMALS = 4


def money_decimals(df: DataFrame) -> int:
    """Decimals of every amount that are summed exactly, a session setting.

    The default holds sums up to 9e14. What an amount has beyond these decimals
    is summed as well, as a double. Overflow is noticed in ANSI mode only, so
    another mode is refused.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise ValueError("sums of money need spark.sql.ansi.enabled")
    return int(conf.get(MONEY_DECIMALS_SETTING, str(MONEY_DECIMALS)))


def round2(x: str) -> str:
    """Two decimals, ties to even on the scaled double (``ROUND`` is half-up)."""
    return f"RINT(({x}) * 100) / 100"


def nan_to_null(x: str) -> str:
    """Missing numbers are NULL everywhere: Spark orders NaN above every number."""
    return f"CASE WHEN NOT ISNAN({x}) THEN {x} END"


def fixed_point(x: str, decimals: int = MONEY_DECIMALS) -> str:
    """The amount as a whole number of 10^-decimals units.

    Sums of these are exact and do not depend on task order, and a BIGINT
    buffer sums several times faster than a DECIMAL one. Under ANSI mode a
    value or sum outside BIGINT stops the job instead of wrapping.
    """
    return f"CAST(RINT(({x}) * 1e{decimals}) AS BIGINT)"


def from_fixed_point(total: str, decimals: int = MONEY_DECIMALS) -> str:
    """A summed ``fixed_point`` as a DECIMAL, wide enough to be summed again."""
    unit = f"0.{'1'.zfill(decimals)}BD" if decimals else "1BD"
    return f"CAST(COALESCE({total}, 0) AS DECIMAL(20,0)) * {unit}"


def money_sum(x: str, decimals: int = MONEY_DECIMALS, test: str = "") -> str:
    """The sum of amounts as a DECIMAL, over the rows of a ``FILTER`` clause if given.

    What rounding to the fixed decimals takes from an amount is summed beside
    it: zero for money that has no more decimals, so such sums stay exact.
    """
    exact = from_fixed_point(f"SUM({fixed_point(x, decimals)}) {test}", decimals)
    rest = f"COALESCE(SUM(({x}) - RINT(({x}) * 1e{decimals}) / 1e{decimals}) {test}, 0D)"
    return f"CAST({exact} + CAST({rest} AS DECIMAL(38,12)) AS DECIMAL(38,12))"


# Bits of the unit of ``exact_sum`` below one, and of its three digits.
EXACT_BITS = 62
_DIGITS = (10, 36, 62)


def exact_sum(x: str) -> str:
    """The sum of doubles as a DECIMAL(38,0), in units of 2^-62: the same in any order.

    A value is cut into three whole numbers, in units of 2^-10, 2^-36 and 2^-62; what is taken off at
    each step is a double without rounding, and sums of the BIGINTs are exact and combine anywhere.
    Values of 2^-10 and more lose nothing, smaller ones are rounded to the unit, ties to even.
    Such sums can be summed again. Under ANSI mode a sum past 2^53 stops the job.
    """
    rest, total = f"({x})", []
    for bits in _DIGITS:
        digit = f"RINT({rest} * {float(1 << bits)!r}D)"
        total.append(f"CAST(COALESCE(SUM(CAST({digit} AS BIGINT)), 0) AS DECIMAL(20,0)) * {1 << (EXACT_BITS - bits)}BD")
        rest = f"({rest} - {digit} / {float(1 << bits)!r}D)"
    return f"CAST({' + '.join(total)} AS DECIMAL(38,0))"


def from_exact(total: str) -> str:
    """An ``exact_sum``, or a sum of them, as the nearest double."""
    return f"(CAST({total} AS DOUBLE) / {float(1 << EXACT_BITS)!r}D)"
