"""Row filters with the reference's null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in_keep_null(c: str | Column, values: Sequence) -> Column:
    """``!x %in% set`` keeps rows where x is null (``~isin`` would drop them)."""
    x = F.col(c) if isinstance(c, str) else c
    return ~F.coalesce(x.isin(*list(values)), F.lit(False))


def complete_cases(df: DataFrame, cols: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Keep ``keep`` (default ``cols``) and drop rows with null *or NaN*
    in any of ``cols`` (``select(...) |> na.omit``)."""
    out = df.select(*(keep or cols))
    return out.na.drop(how="any", subset=list(cols))


def time_window(df: DataFrame, ts: str, lo: str | None, hi: str | None, strict: bool = True) -> DataFrame:
    """P10: ``lo < ts < hi`` (strict both ends by default); pushed to the Parquet scan."""
    c = F.col(ts)
    out = df
    if lo is not None:
        b = F.lit(lo).cast("timestamp_ntz")
        out = out.where(c > b if strict else c >= b)
    if hi is not None:
        b = F.lit(hi).cast("timestamp_ntz")
        out = out.where(c < b if strict else c <= b)
    return out


def upper_outlier_filter(df: DataFrame, value_col: str, ref_col: str, k: float = 3.0) -> DataFrame:
    """Keep rows with ``value < mean(ref) + k·sd(ref)``.

    The threshold comes from a one-row aggregate (two numbers) inlined as a
    literal, so the filter itself is a narrow, codegen'd predicate; a null
    value is dropped as R's ``filter`` drops NA.
    """
    row = df.agg(F.avg(ref_col).alias("m"), F.stddev_samp(ref_col).alias("s")).first()
    if row is None or row["m"] is None or row["s"] is None:
        return df.where(F.lit(False))
    return df.where(F.col(value_col) < F.lit(row["m"] + k * row["s"]))


def zone_filter(df: DataFrame, resid_col: str, fitted_col: str, slope: float = -0.12, intercept: float = 0.8,
                cap: float = 2.0) -> DataFrame:
    """Rows inside the box (resid < cap, fitted < cap) on or below the line."""
    r, f = F.col(resid_col), F.col(fitted_col)
    zone = F.lit(slope) * f + F.lit(intercept)
    return df.withColumn("zone", zone).where((r < cap) & (f < cap) & (r <= F.col("zone")))
