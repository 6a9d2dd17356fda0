"""Expressions shared by the operators, as SQL text for ``F.expr`` and ``selectExpr``.

All of it runs inside generated code; there is no UDF.
"""

from pregao.functions.headers import snake_case, snake_case_all
from pregao.functions.numbers import (
    exact_sum,
    fixed_point,
    from_exact,
    from_fixed_point,
    money_decimals,
    money_sum,
    nan_to_null,
    round2,
)
from pregao.functions.text import currency_text
from pregao.functions.tickers import (
    CORN,
    DERIVATIVES,
    FUTURES,
    in_families,
    three_letter_root,
    ticker_root,
)

__all__ = [
    "CORN",
    "DERIVATIVES",
    "FUTURES",
    "currency_text",
    "exact_sum",
    "fixed_point",
    "from_exact",
    "from_fixed_point",
    "in_families",
    "money_decimals",
    "money_sum",
    "nan_to_null",
    "round2",
    "snake_case",
    "snake_case_all",
    "three_letter_root",
    "ticker_root",
]
