"""Correlation of many series by blocks.

Entities fall into hash blocks of about ``BLOCK``, complete times into chunks of about ``CHUNK``.  A
(chunk, block) becomes one row with a small dense matrix of centred and scaled values; rows of a chunk
meet by pairs of blocks (i ≤ j), each pair is one matrix product, products are added up over chunks as
they stream by, and the lower triangle is the upper one turned round.  No column and no expression per
entity, nothing collected but three counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.session import materialize

BLOCK, CHUNK = 256, 1024


def correlation_blocks(df: DataFrame, time_col: str, entity_col: str, value_col: str, block: int = BLOCK,
                       chunk: int = CHUNK) -> DataFrame:
    """Pearson correlation of every pair of entity series, (entity_1, entity_2, corr), over the times at which
    every entity has a value (``use = "na.or.complete"``).

    A series without variance, or a single complete time, gives null; without a complete time there are no
    rows.  Of several values of an entity at a time one is taken.  Null entities and times don't count."""
    spark = df.sparkSession
    long = (df.select(F.col(time_col).alias("t"), F.col(entity_col).cast("string").alias("e"),
                      F.col(value_col).cast("double").alias("v"))
            .where("t IS NOT NULL AND e IS NOT NULL"))
    n_entities = long.select("e").distinct().count()
    cells = materialize(long.where("v IS NOT NULL AND NOT isnan(v)").groupBy("t", "e").agg(F.first("v").alias("v")))
    times = cells.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_entities).select("t")
    n_times = times.count()
    blocks, chunks = max(1, -(-n_entities // block)), max(1, -(-n_times // chunk))
    full = cells.join(times, "t")
    # centred by each series' own mean before any product
    own = full.groupBy("e").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    full = (full.join(own, "e")
            .select("e", "t", ((F.col("v") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))).alias("z"),
                    F.pmod(F.xxhash64("e"), F.lit(blocks)).cast("int").alias("b"),
                    F.pmod(F.xxhash64("t"), F.lit(chunks)).cast("int").alias("c")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="e", columns="t", values="z").sort_index()
        wide = wide[sorted(wide.columns)]
        return pd.DataFrame([(int(pdf["c"].iloc[0]), int(pdf["b"].iloc[0]), list(wide.index), wide.to_numpy(np.float64).tobytes())],
                            columns=["c", "b", "names", "z"])

    packed = materialize(full.groupBy("c", "b").applyInPandas(pack, "c int, b int, names array<string>, z binary"))
    left, right = packed, packed.select("c", F.col("b").alias("b2"), F.col("names").alias("names2"), F.col("z").alias("z2"))
    pairs = left.join(right, "c").where("b <= b2")
    dof = n_times - 1

    def product(batches):
        for pdf in batches:
            out = []
            for c, b, n1, z1, b2, n2, z2 in pdf.itertuples(index=False):
                a = np.frombuffer(z1).reshape(len(n1), -1)
                d = np.frombuffer(z2).reshape(len(n2), -1)
                out.append((b, b2, list(n1), list(n2), (a @ d.T).tobytes()))
            yield pd.DataFrame(out, columns=["b", "b2", "names", "names2", "m"])

    def rows(b, b2, n1, n2, total):
        r = total / dof if dof > 0 else np.full_like(total, np.nan)
        r = np.clip(r, -1.0, 1.0)
        e1, e2 = np.repeat(np.array(n1, object), len(n2)), np.tile(np.array(n2, object), len(n1))
        yield pd.DataFrame({"entity_1": e1, "entity_2": e2, "corr": r.ravel(), "diagonal": b == b2})

    def add(batches):
        key, names, total = None, None, None
        for pdf in batches:
            for b, b2, n1, n2, m in pdf.itertuples(index=False):
                part = np.frombuffer(m).reshape(len(n1), len(n2))
                if (b, b2) == key:
                    total = total + part
                    continue
                if key:
                    yield from rows(*key, *names, total)
                key, names, total = (b, b2), (n1, n2), part
        if key:
            yield from rows(*key, *names, total)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks * (blocks + 1) // 2, 20_000))
    products = pairs.select("c", "b", "names", "z", "b2", "names2", "z2").mapInPandas(
        product, "b int, b2 int, names array<string>, names2 array<string>, m binary")
    upper = (products.repartition(width, "b", "b2").sortWithinPartitions("b", "b2")
             .mapInPandas(add, "entity_1 string, entity_2 string, corr double, diagonal boolean"))
    upper = upper.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    turned = F.array(F.struct("entity_1", "entity_2"), F.struct(F.col("entity_2").alias("entity_1"),
                                                               F.col("entity_1").alias("entity_2")))
    one = F.array(F.struct("entity_1", "entity_2"))
    return upper.select("corr", F.inline(F.when(F.col("diagonal"), one).otherwise(turned))) \
        .select("entity_1", "entity_2", "corr")
