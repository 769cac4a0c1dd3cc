"""Descriptive aggregations.

Every statistic is a built-in aggregate with map-side partial aggregation;
exact quantiles come from :mod:`kairos.operators.quantiles`, so a hot group
never has to fit in one task (``approx=True`` switches to ``percentile_approx``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.operators.panel import join_groups, left_join, pivot_longer
from kairos.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def _with_quartiles(df: DataFrame, by: Sequence[str], col: str, approx: bool, aggs: list[Column]) -> DataFrame:
    """Grouped aggregates plus ``_q`` = [q1, median, q3]."""
    if approx:
        return df.groupBy(*by).agg(*aggs, F.percentile_approx(col, list(QUARTILES), 100000).alias("_q"))
    return left_join(df.groupBy(*by).agg(*aggs), exact_quantiles(df, by, col, QUARTILES), list(by), null_safe=True)


def strict_avg(c: str) -> Column:
    """Mean without ``na.rm`` — null as soon as one input is null (or NaN)."""
    x = F.col(c)
    bad = F.count_if(x.isNull() | F.isnan(x))
    return F.when(bad > 0, F.lit(None).cast("double")).otherwise(F.avg(x))


def group_stats(df: DataFrame, by: Sequence[str], col: str, approx: bool = False, order_by_mean: bool = True) -> DataFrame:
    """Mean, sd, median, IQR per group (quantile type 7), sorted by mean."""
    out = (_with_quartiles(df, by, col, approx, [F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
                                                 F.count(col).alias("n")])
             .withColumn("median", F.col("_q")[1])
             .withColumn("iqr", F.col("_q")[2] - F.col("_q")[0])
             .drop("_q"))
    return out.orderBy(F.asc_nulls_last("mean")) if order_by_mean else out


def spatial_mean(df: DataFrame, by: Sequence[str], strict: Sequence[str] = (), skip_na: Sequence[str] = ()) -> DataFrame:
    """Mean of all cells per hour; ``strict`` columns follow N1."""
    aggs = [strict_avg(c).alias(c) for c in strict] + [F.avg(c).alias(c) for c in skip_na]
    return df.groupBy(*by).agg(*aggs)


def prepost_summary(df: DataFrame, flag: str, cols: Sequence[str], digits: int = 2,
                    keep_null_period: bool = False) -> DataFrame:
    """Mean and sd of each column by period, long by variable, rounded half-even.
    Rows without a period are left out unless ``keep_null_period``.

    One grouped aggregate (partial), then an unpivot and a pivot on the tiny
    result: (flag, variable, mean, sd).
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    wide = (df if keep_null_period else df.where(F.col(flag).isNotNull())).groupBy(flag).agg(*aggs)
    long = pivot_longer(wide, [flag], [f"{c}_{s}" for c in cols for s in ("mean", "sd")],
                        names_to=("variable", "statistic"), sep="_")
    long = long.withColumn("value", F.bround("value", digits))
    return long.groupBy(flag, "variable").pivot("statistic", ["mean", "sd"]).agg(F.first("value"))


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(variable, position, n_miss, pct_miss) for every column in one pass."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c)
        miss = x.isNull() | F.isnan(x) if dict(df.dtypes)[c] in ("double", "float") else x.isNull()
        aggs.append(F.count_if(miss).alias(f"m__{c}"))
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(i + 1).alias("position"),
                                         F.col(f"m__{c}").alias("n_miss")) for i, c in enumerate(cols)]))
    return (wide.select(F.col("_n"), stack.alias("s"))
                .select("s.variable", "s.position", "s.n_miss",
                        (F.col("s.n_miss") * 100.0 / F.col("_n")).alias("pct_miss")))


def freq_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts of every value of every column, always with a null row.

    Columns are stacked to (variable, value) so one shuffle serves them all;
    a zero-count null row is added per variable when no value is missing.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
                                            for c in cols])).alias("s")).select("s.*")
    counts = stacked.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    seeds = df.sparkSession.createDataFrame([(c, None, 0) for c in cols], "variable string, value string, n long")
    return counts.unionByName(seeds).groupBy("variable", "value").agg(F.sum("n").cast("bigint").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-way counts in long form; null on either side is dropped (``table``)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
              .groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))


def column_summary(df: DataFrame, by: Sequence[str], col: str, approx: bool = False) -> DataFrame:
    """Min, quartiles, mean, max and NA count per group (``summary``)."""
    return (_with_quartiles(df, by, col, approx, [F.min(col).alias("min"), F.avg(col).alias("mean"),
                                                  F.max(col).alias("max"),
                                                  F.count_if(F.col(col).isNull()).alias("n_na")])
              .select(*by, "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), "mean",
                      F.col("_q")[2].alias("q3"), "max", "n_na"))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """``bins`` equal-width bins whose first and last are centred on min and max.

    Width = range/(bins−1); bin k covers (origin + k·w, origin + (k+1)·w], the
    first bin also takes its left edge.  Range from one small aggregate over
    non-null, non-NaN values, then one grouped count; empty bins are rows with n = 0,
    and a column without values has no bins.
    """
    x = F.col(col).cast("double")
    clean = df.where(x.isNotNull() & ~F.isnan(x))
    r = clean.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 0.0)
    width = (hi - lo) / (bins - 1) if hi > lo else 1.0
    origin = lo - width / 2.0
    k = F.ceil((x - F.lit(origin)) / F.lit(width)) - 1
    k = F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)).cast("int")
    n = clean.groupBy(*by, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = clean.select(*by).distinct() if by else clean.sparkSession.range(1 if r["lo"] is not None else 0)
    every = every.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (left_join(every, n, [*by, "bin"], null_safe=True).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
              .withColumn("x_min", F.lit(origin) + F.col("bin") * F.lit(width))
              .withColumn("x_max", F.lit(origin) + (F.col("bin") + 1) * F.lit(width))
              .select(*by, "bin", "x_min", "x_max", "n"))


# Wind-speed class cut points (m/s) used for the wind rose.
WIND_SPEED_CUTS = (3.0, 6.0, 9.0, 12.0)


def speed_class(speed: str | Column, cuts: Sequence[float] = WIND_SPEED_CUTS) -> Column:
    """Speed class label ``[a,b)``; values below the first cut are ``[0,a)``."""
    s = F.col(speed) if isinstance(speed, str) else speed
    edges = [0.0, *cuts]
    expr = None
    for a, b in zip(edges, edges[1:]):
        lab = F.lit(f"[{a:g},{b:g})")
        cond = s < b
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr.when(s >= edges[-1], F.lit(f"[{edges[-1]:g},inf)"))


def wind_rose(df: DataFrame, period: str, direction: str, speed: str, sectors: int = 8,
              cuts: Sequence[float] = WIND_SPEED_CUTS) -> DataFrame:
    """Count and share of hours by period × direction sector × speed class.

    Sector index k covers [k·w − w/2, k·w + w/2) with w = 360/sectors (0 = North).
    The share is a window sum over the already tiny grouped table.
    """
    w = 360.0 / sectors
    d = F.col(direction)
    sector = F.floor(F.pmod(d + F.lit(w / 2.0), F.lit(360.0)) / F.lit(w)).cast("int")
    g = (df.where(d.isNotNull() & F.col(speed).isNotNull())
           .groupBy(period, sector.alias("sector"), speed_class(speed, cuts).alias("speed_class"))
           .agg(F.count(F.lit(1)).alias("n")))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(period)))


def box_stats(df: DataFrame, by: Sequence[str], col: str, approx: bool = False) -> DataFrame:
    """Quartiles, 1.5·IQR fences, whisker ends and outlier counts per group."""
    q = (_with_quartiles(df.where(F.col(col).isNotNull()), by, col, approx, [F.count(F.lit(1)).alias("_n")])
           .select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")))
    q = q.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    x = F.col(col)
    inside = (x >= F.col("lower_fence")) & (x <= F.col("upper_fence"))
    return (join_groups(df.where(x.isNotNull()), q, by)
              .groupBy(*by, "q1", "median", "q3", "lower_fence", "upper_fence")
              .agg(F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
                   F.count_if(~inside).alias("n_out"), F.count(F.lit(1)).alias("n")))


def mean_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Plain (na.rm) means per group."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])
