"""Feature building: sequence index, z-scores, ITS features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.operators.panel import join_groups, left_join


def sequence_index(df: DataFrame, partition_cols: Sequence[str], order_col: str, out: str = "time_elapsed",
                   block: str = "7 days") -> DataFrame:
    """1-based ``row_number()`` within each partition ordered by ``order_col``.

    A plain window puts a whole entity (possibly a third of all rows) in one
    sorted task.  Here rows are cut into time blocks; per-(entity, block)
    counts are partially aggregated, turned into running offsets over the
    small block table, and each block numbers its own rows — the window only
    ever holds one block.  Rows without an order value come last.  Equal to ``row_number`` whenever ``order_col`` is
    unique within a partition (ties are broken arbitrarily in both).
    """
    keys = list(partition_cols)
    number, unit = block.split()
    width = int(number) * {"day": 86400, "hour": 3600, "minute": 60}[unit.rstrip("s")]
    secs = F.unix_seconds(F.col(order_col).cast("timestamp"))
    # rows without an order value form the last block
    tagged = df.withColumn("_blk", F.coalesce(F.floor(secs / width), F.lit(1 << 60)).cast("bigint"))
    # block sizes are partial counts on the raw key; rows are numbered inside their block
    counts = tagged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    ranked = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order_col)))
    return (left_join(ranked, offsets, [*keys, "_blk"], null_safe=True)
                  .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
                  .drop("_blk", "_off", "_rn"))


def grid_index(ts: str | Column, t0: str, step_seconds: int = 3600) -> Column:
    """W1 on a complete, gap-free grid: ``(ts − t0)/step + 1`` with no shuffle at all."""
    c = F.col(ts) if isinstance(ts, str) else ts
    t0c = F.lit(t0).cast("timestamp_ntz")
    secs = F.unix_seconds(c.cast("timestamp")) - F.unix_seconds(t0c.cast("timestamp"))
    return (F.floor(secs / step_seconds) + 1).cast("bigint")


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and sample sd of several columns in one pass (a single small row)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m__{c}"), F.stddev_samp(c).alias(f"s__{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m__{c}"], row[f"s__{c}"]) for c in cols}


def zscore_global(df: DataFrame, cols: Sequence[str], suffix: str = "_scale") -> DataFrame:
    """``scale()`` of each column over the whole table (n−1 sd).

    The two moments per column are computed once and inlined as literals; no
    unpartitioned window, no join.  sd = 0 gives null like R's NaN.
    """
    mom = column_moments(df, cols)
    out = {}
    for c in cols:
        m, s = mom[c]
        out[f"{c}{suffix}"] = ((F.col(c) - F.lit(m)) / F.lit(s)) if (m is not None and s) else F.lit(None).cast("double")
    return df.withColumns(out)


def zscore_by(df: DataFrame, col: str, by: Sequence[str], out: str | None = None) -> DataFrame:
    """Z-score within groups; group moments by partial aggregation, joined back."""
    out = out or f"{col}_scale"
    mom = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    return (join_groups(df, mom, by)
              .withColumn(out, (F.col(col) - F.col("_m")) / F.col("_s"))
              .drop("_m", "_s"))
