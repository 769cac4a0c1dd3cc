"""Numeric helpers: half-even rounding, clamps, fills, scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 0) -> Column:
    """R's ``round`` (IEC 60559 half-to-even) is Spark ``bround``."""
    return F.bround(_c(c), digits)


def clamp_below(c, threshold: float = 1.0, replacement: float = 0.1) -> Column:
    """``ifelse(y < t, r, y)``; null stays null."""
    x = _c(c)
    return F.when(x < threshold, F.lit(replacement)).otherwise(x)


def fill_missing(c, fallback) -> Column:
    """``ifelse(is.na(a), b, a)``; NaN counts as missing like R's ``is.na``."""
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x), _c(fallback)).otherwise(x)


def chi2_tail(x: float, df: int) -> float:
    """P(χ² > x) for ``df`` degrees of freedom: the normal tail (odd df) or 1 (even df) and a finite sum."""
    if df < 1:
        raise ValueError("df must be at least 1")
    if not x > 0:
        return 1.0 if x <= 0 else math.nan
    half = x / 2.0
    term = math.exp(-half) * (1.0 if df % 2 == 0 else math.sqrt(half) * 2.0 / math.sqrt(math.pi))
    total = 0.0 if df % 2 == 0 else math.erfc(math.sqrt(half))
    for k in range(df // 2 if df % 2 == 0 else (df - 1) // 2):
        total += term
        term *= half / (k + (1.0 if df % 2 == 0 else 1.5))
    return total
