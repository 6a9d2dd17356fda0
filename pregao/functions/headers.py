"""Header normalisation: CamelCase export headers become snake_case columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# The two word-boundary patterns of the common `underscore` rule.
ACRONYM_THEN_WORD = re.compile(r"([A-Z]+)([A-Z][a-z])")
LOWER_THEN_UPPER = re.compile(r"([a-z\d])([A-Z])")


def snake_case(name: str) -> str:
    """``HTTPCode`` -> ``http_code``; accents and blanks are left alone."""
    split = ACRONYM_THEN_WORD.sub(r"\1_\2", name)
    split = LOWER_THEN_UPPER.sub(r"\1_\2", split)
    return split.replace("-", "_").lower()


def snake_case_all(df: DataFrame) -> DataFrame:
    """Rename every column by position, so headers that differ only in case are safe."""
    return df.toDF(*[snake_case(c) for c in df.columns])
