"""String similarities that Spark has no expression for, as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """0 to 100: the best ratio among the shared words and each side's words with them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = sorted(x & y)
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(sorted(s.difference(both))) for s in (x, y))
    if not both:
        return ratio(left, right)
    # Each side is the shared words, a space and its own words, so all three ratios follow from what the own words have in common.
    n = len(" ".join(both))
    a, b = n + 1 + len(left), n + 1 + len(right)
    return max(200.0 * (n + 1 + lcs(left, right)) / (a + b), 200.0 * n / (n + a), 200.0 * n / (n + b))


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x or "", y or "") for x, y in zip(a, b, strict=True)])
