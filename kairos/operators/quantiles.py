"""Exact quantiles (type 7) whose groups never meet in one task.

Values are counted per (group, value), range-partitioned by (group, value) and written
once; each partition's totals give the rank at which it starts, a running sum inside
it gives the ranks of its values, and only the two values around each quantile leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairos.session import materialize


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float],
                    out: str = "_q") -> DataFrame:
    """(by..., out): array of the quantiles of non-null, non-NaN ``col`` per group; groups without any are absent."""
    keys = list(by)
    x = F.col(col).cast("double")
    counts = (df.select(*keys, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
              .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(counts.repartitionByRange(width, *keys, "_x").withColumn("_p", F.spark_partition_id()))
    # totals of each (group, partition): at most partitions + groups rows
    parts = placed.groupBy(*keys, "_p").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_kp"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                          F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    same = F.col("_p") == F.col("_kp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_p").orderBy("_x")
    ranked = (placed.withColumn("_run", F.sum("_c").over(inside)).join(starts, same)
              .withColumn("_to", F.col("_before") + F.col("_run")).withColumn("_from", F.col("_to") - F.col("_c")))
    picks = []
    for j, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_all") - 1)
        for side, rank in ((0, F.floor(h)), (1, F.ceil(h))):
            picks.append(F.struct(F.lit(2 * j + side).alias("i"), ((F.col("_from") <= rank) & (rank < F.col("_to")))
                                  .alias("hit"), (h - F.floor(h)).alias("w")))
    found = (ranked.select(*keys, "_x", F.explode(F.array(*picks)).alias("_s")).where("_s.hit")
             .groupBy(*keys).agg(*[F.max(F.when(F.col("_s.i") == i, F.col("_x"))).alias(f"_v{i}")
                                   for i in range(2 * len(probs))],
                                 *[F.max(F.when(F.col("_s.i") == 2 * j, F.col("_s.w"))).alias(f"_w{j}")
                                   for j in range(len(probs))]))
    q = [F.col(f"_v{2 * j}") + (F.col(f"_v{2 * j + 1}") - F.col(f"_v{2 * j}")) * F.col(f"_w{j}")
         for j in range(len(probs))]
    return found.select(*keys, F.array(*q).alias(out))


def global_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float] | None:
    """Quantiles of a whole column as numbers; None without values."""
    row = exact_quantiles(df.select(F.lit(0).alias("_g"), col), ["_g"], col, probs).first()
    return None if row is None else [float(v) for v in row["_q"]]
