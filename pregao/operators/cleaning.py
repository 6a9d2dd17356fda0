"""From the raw ledger to closed trades with their derived measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pregao.functions import nan_to_null

# Fixed value: longer trades are recording errors.
DURATION_LIMIT = 32000

MEASURES = ("liquido", "bruto", "preco", "quantidade", "duracao")

# The closing leg tells the opposite side of the trade; anything but a sale was a sale.
INVERTED_SIDE = "CASE WHEN lado = 'Venda' THEN 'Compra' ELSE 'Venda' END"
VALUE_PER_CONTRACT = "TRY_DIVIDE(liquido, quantidade)"
VALUE_PER_SHARE = "TRY_DIVIDE(liquido, preco * quantidade)"
# 1 for a win, -1 for a loss, 0 for neither or unknown.
OUTCOME_SIGN = "CASE WHEN liquido > 0 THEN 1 WHEN liquido < 0 THEN -1 ELSE 0 END"


def closed_trades(df: DataFrame) -> DataFrame:
    """Drop the opening legs, whose net or gross result is zero; a missing result stays."""
    return df.where("NOT (liquido <=> 0D) AND NOT (bruto <=> 0D)")


def duration_cap(df: DataFrame, limit: int = DURATION_LIMIT) -> DataFrame:
    """Keep trades shorter than the limit; a missing duration is dropped."""
    return df.where(f"duracao < {limit}")


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN in a floating-point measure becomes NULL."""
    floating = [
        f.name
        for f in df.schema.fields
        if f.name in MEASURES and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.expr(nan_to_null(c)) for c in floating}) if floating else df


def clean(df: DataFrame) -> DataFrame:
    """Closed trades with side, result per unit and outcome.

    The row filters come first and use the stored columns only, so they reach
    the scan.
    """
    derived = {
        "lado": INVERTED_SIDE,
        "valor_por_contrato": VALUE_PER_CONTRACT,
        "ranking": OUTCOME_SIGN,
        "valor_por_acao": VALUE_PER_SHARE,
    }
    closed = missing_as_null(duration_cap(closed_trades(df)))
    return closed.withColumns({name: F.expr(rule) for name, rule in derived.items()})
