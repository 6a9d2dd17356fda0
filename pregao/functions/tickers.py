"""Ticker families and roots."""

from __future__ import annotations

# Three-letter prefixes of the futures families.
FUTURES = ("WDO", "WIN", "DOL", "IND")
CORN = ("CCM",)
DERIVATIVES = FUTURES + CORN


def three_letter_root(codigo: str = "codigo") -> str:
    return f"SUBSTRING({codigo}, 1, 3)"


def in_families(families: tuple[str, ...], codigo: str = "codigo") -> str:
    """Prefix test in a form that Parquet scans take, negated or not, to pass over row groups."""
    return "(" + " OR ".join(f"STARTSWITH({codigo}, '{family}')" for family in families) + ")"


def ticker_root(codigo: str = "codigo") -> str:
    """Fold the contract months of a derivative into one ticker; shares stay as they are."""
    listed = ", ".join(f"'{family}'" for family in DERIVATIVES)
    root = three_letter_root(codigo)
    return f"CASE WHEN {root} IN ({listed}) THEN {root} ELSE {codigo} END"
