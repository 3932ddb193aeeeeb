"""The two things Spark has no built-in for: Unicode decomposition, sequence similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _without_accents(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without combining marks."""
    return texts.map(_without_accents)


def _ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of each pair; for pairs an equi join has already found."""
    return pd.Series([_ratio(a, b) for a, b in zip(left, right)], dtype="float64")
