"""Upper tails of the normal and χ² distributions as Column expressions.

erfc comes from a series below 2 and a continued fraction above, both as folds over a literal
sequence; a χ² tail with any whole number of degrees of freedom is erfc (odd) or 1 (even) and a
finite sum.  Nothing here needs a Python worker.  Null gives null, NaN gives NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series, steps of the continued fraction: enough for full precision on either side of 2.
TERMS = 80


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def erfc(c: str | Column) -> Column:
    """Complementary error function."""
    raw = _c(c).cast("double")
    x = F.abs(raw)
    # erf(x) = 2/√π e^{-x²} Σ x (2x²)^n / (1·3·5···(2n+1))
    fold = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), F.struct(x.alias("term"), x.alias("total")),
        lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"),
                              (a["total"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("total")),
        lambda a: a["total"])
    low = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * fold
    # erfc(x) = e^{-x²}/(x√π) / (1 + (1/2x²)/(1 + (2/2x²)/(1 + …)))
    part = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), F.lit(1.0), lambda a, k: 1 + k / (2 * x * x) / a)
    high = F.exp(-x * x) / (x * F.lit(math.sqrt(math.pi))) / part
    value = F.when(x < 2, low).otherwise(high)
    return F.when(F.isnan(raw), raw).when(raw < 0, 2 - value).otherwise(value)


def normal_upper_tail(c: str | Column) -> Column:
    """P(Z > z) of a standard normal."""
    return erfc(_c(c) / F.lit(math.sqrt(2.0))) / 2


def chi2_upper_tail(c: str | Column, df: int = 1) -> Column:
    """P(χ² > x) with ``df`` degrees of freedom; 1 at or below nought."""
    if df < 1:
        raise ValueError("df must be at least 1")
    raw = _c(c).cast("double")
    half = F.greatest(raw, F.lit(0.0)) / 2
    odd = df % 2 == 1
    total = erfc(F.sqrt(half)) if odd else F.lit(0.0)
    term = F.exp(-half) * (F.sqrt(half) * F.lit(2 / math.sqrt(math.pi)) if odd else F.lit(1.0))
    for k in range(df // 2):
        total = total + term
        term = term * half / (k + (1.5 if odd else 1.0))
    return F.when(F.isnan(raw), raw).when(raw.isNotNull(), total)
