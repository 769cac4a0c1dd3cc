"""Ordered and series operators.

Nothing here sorts a whole series in one task: rolling means run on already
aggregated daily tables, the ACF works on fixed-size index blocks with a
halo of ``max_lag`` rows, and global ranks use range partitions plus offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.operators.panel import join_groups
from kairos.operators.quantiles import global_quantiles
from kairos.session import materialize


def rolling_mean(df: DataFrame, by: Sequence[str], order_col: str, col: str, k: int = 14, out: str | None = None,
                 by_range: bool = False) -> DataFrame:
    """Right-aligned k-row moving average, null until k rows are available.

    Default counts *rows* (reference parity, Q7); ``by_range`` uses the
    previous k−1 days of ``order_col`` instead.  Meant for aggregated daily
    tables (hundreds of rows per series).
    """
    out = out or f"{col}_roll{k}"
    base = Window.partitionBy(*by).orderBy(order_col)
    if by_range:
        o = F.unix_date(F.col(order_col).cast("date"))
        base = Window.partitionBy(*by).orderBy(o)
        w = base.rangeBetween(-(k - 1), 0)
    else:
        w = base.rowsBetween(-(k - 1), 0)
    full = F.count(F.lit(1)).over(w) == k
    return df.withColumn(out, F.when(full, F.avg(col).over(w)))


_ACF_OUT = "lag int, s double, nu long"


def acf(df: DataFrame, idx_col: str, value_col: str, series: Sequence[str] = (), max_lag: int = 100,
        block: int = 4096) -> DataFrame:
    """Sample autocorrelation with ``na.action = na.pass``.

    Definition (R's): c = x − mean(x, non-missing); γ(l) = Σ c_t c_{t+l} / (ν_l + l)
    over the ν_l pairs with both ends present; ρ(l) = γ(l)/γ(0).  ``idx_col`` is
    the position in the series, from any origin; absent positions are missing values.

    Execution: rows go to blocks of ``block`` positions; the first ``max_lag``
    rows of each block are copied to the previous block as a halo, so every
    lagged pair lives inside one bounded group.  Each group returns ≤ max_lag+1
    partial sums, which a grouped sum combines.  Input copied: 1 + max_lag/block.
    """
    if block < max_lag:
        raise ValueError("block must be at least max_lag")
    keys = list(series)
    x = F.col(value_col)
    valid = df.where(x.isNotNull() & ~F.isnan(x))
    if keys:
        means = valid.groupBy(*keys).agg(F.avg(value_col).alias("_mu"))
        centred = join_groups(valid, means, keys).withColumn("_c", x - F.col("_mu"))
    else:
        mu = valid.agg(F.avg(value_col)).first()[0]
        centred = valid.withColumn("_c", x - F.lit(mu))
    pos = F.col(idx_col).cast("bigint")
    own = F.expr(f"(`{idx_col}` - pmod(`{idx_col}`, {block})) div {block}")
    # the first rows of a block also go to the block before, in the same pass
    blocks = F.when(F.pmod(pos, F.lit(block)) < max_lag, F.array(own, own - 1)).otherwise(F.array(own))
    parts = centred.select(*keys, pos.alias("_p"), "_c", F.explode(blocks).alias("_b"))

    def block_sums(key, pdf):
        b = int(key[-1])
        base = b * block
        arr = np.full(block + max_lag, np.nan)
        arr[(pdf["_p"].to_numpy() - base).astype(np.int64)] = pdf["_c"].to_numpy()
        head = arr[:block]
        lags, sums, nus = [], [], []
        for lag in range(max_lag + 1):
            prod = head * arr[lag:lag + block]
            ok = ~np.isnan(prod)
            lags.append(lag)
            sums.append(float(prod[ok].sum()))
            nus.append(int(ok.sum()))
        out = pd.DataFrame({"lag": lags, "s": sums, "nu": nus})
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        return out

    schema = T.StructType([*[parts.schema[k] for k in keys],
                           *T._parse_datatype_string(_ACF_OUT).fields])
    sums = parts.groupBy(*keys, "_b").applyInPandas(block_sums, schema)
    tot = sums.groupBy(*keys, "lag").agg(F.sum("s").alias("s"), F.sum("nu").alias("nu"))
    gamma = F.when(F.col("nu") > 0, F.col("s") / (F.col("nu") + F.col("lag")))
    g0 = F.first(F.when(F.col("lag") == 0, gamma), ignorenulls=True).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return tot.select(*keys, "lag", (gamma / g0).alias("acf"), F.col("nu").alias("n_pairs"))


def pacf(acf_table: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelation by Durbin–Levinson on the (≤ max_lag+1 row) ACF table."""
    keys = list(series)

    def dl(key, pdf):
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy()
        m = len(r) - 1
        out = np.full(m, np.nan)
        phi = np.zeros(m + 1)
        v = 1.0
        for k in range(1, m + 1):
            if k == 1:
                a = r[1]
            else:
                a = (r[k] - np.dot(phi[1:k], r[1:k][::-1])) / v
            new = phi.copy()
            new[k] = a
            for j in range(1, k):
                new[j] = phi[j] - a * phi[k - j]
            phi = new
            v = v * (1 - a * a)
            out[k - 1] = a
        res = pd.DataFrame({"lag": np.arange(1, m + 1, dtype=np.int32), "pacf": out})
        for i, k in enumerate(keys):
            res.insert(i, k, key[i])
        return res

    schema = T.StructType([*[acf_table.schema[k] for k in keys],
                           T.StructField("lag", T.IntegerType()), T.StructField("pacf", T.DoubleType())])
    grouped = acf_table.groupBy(*keys) if keys else acf_table.groupBy(F.lit(0).alias("_all"))
    if keys:
        return grouped.applyInPandas(dl, schema)
    return acf_table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        lambda k, p: dl((), p), schema)


def global_rank(df: DataFrame, col: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based position of each row in ascending ``col`` order, without a
    single-partition window: rows are range-partitioned (ties split by arrival), written
    once and numbered inside their partition, after the rows of the partitions before.  ``buckets``: partitions, by
    default the session's shuffle width."""
    width = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = materialize(tagged.repartitionByRange(width, col, "_tie").withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_p"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(col, "_tie"))
    return (placed.withColumn("_rn", inside).join(before, "_p")
                  .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_p", "_off", "_rn", "_tie"))


# Coefficients of Acklam's rational approximation to the
# standard normal quantile function (relative error below 1.2e-9).
_QA = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_QB = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
       6.680131188771972e+01, -1.328068155288572e+01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
       -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
_P_LOW = 0.02425


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_quantile(p: str | Column) -> Column:
    """Standard normal quantile as a JVM Column expression (no Python UDF)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r = q * q
    central = _horner(_QA, r) * q / (_horner(_QB, r) * r + 1.0)
    ql = F.sqrt(-2.0 * F.log(p))
    low = _horner(_QC, ql) / (_horner(_QD, ql) * ql + 1.0)
    qu = F.sqrt(-2.0 * F.log(1.0 - p))
    high = -_horner(_QC, qu) / (_horner(_QD, qu) * qu + 1.0)
    return (F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(None).cast("double"))
             .when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(central))


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """Normal QQ points (``qqnorm``: ppoints with a = 3/8 for n ≤ 10 else 1/2)
    plus the reference line through the quartiles as two extra columns."""
    x = F.col(col)
    clean = df.where(x.isNotNull() & ~F.isnan(x)).select(col)
    n = clean.count()
    a = 3.0 / 8.0 if n <= 10 else 0.5
    ranked = global_rank(clean, col, "rank")
    pts = ranked.withColumn("theoretical", norm_quantile((F.col("rank") - a) / F.lit(n + 1 - 2 * a)))
    q1, q3 = global_quantiles(clean, col, [0.25, 0.75]) or (float("nan"), float("nan"))
    z1, z3 = -0.6744897501960817, 0.6744897501960817
    slope = (q3 - q1) / (z3 - z1)
    return pts.withColumn("line_slope", F.lit(slope)).withColumn("line_intercept", F.lit(q1 - slope * z1))
