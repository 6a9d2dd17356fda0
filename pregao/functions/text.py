"""Display text."""

from __future__ import annotations


def currency_text(x: str) -> str:
    """``1234.5`` -> ``R$ 1,234.50``."""
    return f"CONCAT('R$ ', FORMAT_NUMBER({x}, 2))"
