"""Shared helpers: table access, byte-bounded Arrow batches, lineage cuts, word
hashing and distributed connected components."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.session import materialize
from kairos.sources.tables import load_table

__all__ = ["configure", "table", "materialize", "words", "hash_words", "ngrams", "blob_rows",
           "partitions_for", "connected_components", "WS", "MIX"]

#: ASCII white space; words are the maximal runs of anything else.
WS = r"[\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def configure(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: texts may be 100 kB and more each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    configure(spark)
    return load_table(spark, sf_dir, name, list(columns) or None)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased (other letters are left alone)."""
    return text.lower().split() if text else []


def hash_words(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a word-hash array (len - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out) + h[k:k + m]
    return mix(out)


def blob_rows(bucket: np.ndarray, columns: list[np.ndarray], n: int):
    """Group parallel arrays by bucket: yields (bucket, [bytes per column]).

    One row per bucket and batch instead of one per value keeps the shuffle at
    the size of the packed values."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, int)
    cols = [c[order] for c in columns]
    for i, s in enumerate(cut):
        e = cut[i + 1] if i + 1 < len(cut) else len(b)
        yield int(b[s]), [c[s:e].tobytes() for c in cols]


def partitions_for(spark: SparkSession, units: float, per_task: float) -> int:
    """Task count for ``units`` of work, never below the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(units / per_task))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph: (node, component = smallest node).

    ``edges`` has columns u, v of one orderable type; isolated nodes are not
    returned, loops and repeated edges are allowed, an empty graph gives an
    empty frame.  Alternating large-star / small-star rounds (Kiveris et al.
    2014): every round is two grouped minima (combined map-side) and two
    equi-joins whose hot hubs AQE can split; each round is written to the
    shared checkpoint folder, so a lost executor never replays earlier rounds.
    """
    e = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .distinct())
    e = materialize(e)
    last = _digest(e)
    if not last[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = _digest(e)
        if now == last:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
