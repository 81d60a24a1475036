"""Vectorised helpers for what built-in functions can't express."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, ch in enumerate(b):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for ch in a:
        u = row & at.get(ch, 0)
        row = (row + u | row - u) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two texts; null if either is null."""
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")
