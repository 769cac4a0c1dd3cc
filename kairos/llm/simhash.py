"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits variants within half the radius; the
variants are shuffled, equal ones meet, and the meeting fingerprints are linked
after an exact bit count.  For radius 3 the ball of radius 2 is pruned without
losing a link:

* parity: a pair at odd distance has one fingerprint of even and one of odd
  weight, so the even side may reach 2 bits and the odd side 1 bit;
* of any three bits two lie in the same 32-bit half, so two-bit variants within
  one half (992 of 2016) are enough.

Even fingerprints emit themselves, 64 one-bit and 992 two-bit variants, odd ones
64 one-bit variants.  At one variant, an odd fingerprint is within 3 bits of all
others there, and even ones reached by at most one bit are within 2 bits of one
another: a star around one of them carries every link, so a crowded variant
costs its size, never its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import blob_rows, configure, connected_components, materialize, mix, partitions_for, words

RADIUS = 3
SHINGLE = 3
SEED = 42
#: A list of at most this many rows (a few MB) is broadcast against the documents; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Variants that one task gathers; 10 bytes each.
PER_TASK = 1_500_000

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_PAIR = np.array([(1 << i) | (1 << j) for lo in (0, 32) for i in range(lo, lo + 32) for j in range(i + 1, lo + 32)],
                 np.uint64)
#: Flip masks by code: itself, one bit, two bits of one half (even side), one bit (odd side).
MASKS = np.concatenate([np.zeros(1, np.uint64), _ONE, _PAIR, _ONE])
_EVEN = np.arange(1 + 64 + len(_PAIR), dtype=np.uint16)
_ODD = np.arange(1 + 64 + len(_PAIR), len(MASKS), dtype=np.uint16)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Majority of the XXH64 bits of all word shingles, repeats included; 0 without words."""
    w = words(text)
    if not w:
        return 0
    norm = b" ".join(w)
    if len(w) <= size:
        h = np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = [0, *(ends[:len(w) - size] + 1).tolist()]
        hash64 = xxhash.xxh64_intdigest
        h = np.fromiter((hash64(norm[a:b], SEED) for a, b in zip(starts, ends[size - 1:].tolist())),
                        np.uint64, len(w) - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16384):
        part = h[i:i + 16384].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long.  With ``digest`` also the text's MD5."""
    configure(docs.sparkSession)
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"),
                       *([_text_digest(text_col).alias("digest")] if digest else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]],
                                             names=["id", "fp", "digest"][:b.num_columns])

    kind = lean.schema["id"].dataType.simpleString()
    return lean.mapInArrow(run, f"id {kind}, fp long" + (", digest string" if digest else ""))


def _text_digest(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def _emit(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            odd = (np.bitwise_count(fp) & 1).astype(bool)
            parts = [((fp[s][:, None] ^ MASKS[c][None, :]).ravel(), np.tile(c, int(s.sum())))
                     for s, c in ((~odd, _EVEN), (odd, _ODD))]
            variant = np.concatenate([p[0] for p in parts])
            code = np.concatenate([p[1] for p in parts])
            bucket = (mix(variant) >> np.uint64(33)) % np.uint64(buckets)
            rows = list(blob_rows(bucket.astype(np.uint32), [variant, code], buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.binary()),
                 pa.array([r[1][1] for r in rows], pa.binary())], names=["bucket", "variant", "code"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vs, cs = [], []
    for b in batches:
        vs += [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
        cs += [np.frombuffer(x, np.uint16) for x in b.column(2).to_pylist()]
    u = v = np.empty(0, np.uint64)
    if vs:
        variant, code = np.concatenate(vs), np.concatenate(cs)
        del vs, cs
        order = np.argsort(variant)
        variant, code = variant[order], code[order]
        same = variant[1:] == variant[:-1]
        keep = np.r_[same, False] | np.r_[False, same]          # variants that two or more reach
        variant, code = variant[keep], code[keep]
        if len(variant):
            fp = variant ^ MASKS[code]
            start = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
            run = np.cumsum(np.r_[True, variant[1:] != variant[:-1]]) - 1
            odd, near = code >= len(_EVEN), code <= 64
            high = np.uint64(0xFFFFFFFFFFFFFFFF)
            by_odd = np.logical_or.reduceat(odd, start)
            hub = np.where(by_odd, np.minimum.reduceat(np.where(odd, fp, high), start),
                           np.minimum.reduceat(np.where(near, fp, high), start))[run]
            link = (by_odd[run] | near) & (fp != hub)
            u, v = fp[link], hub[link]
            good = np.bitwise_count(u ^ v) <= RADIUS
            u, v = u[good], v[good]
            if len(u):
                pairs = np.unique(np.stack([u, v], 1), axis=0)
                u, v = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked at RADIUS or fewer bits.

    ``fps`` has one row per distinct ``fp``.  The edges span the same
    components as the full link set (see the module text)."""
    spark = fps.sparkSession
    total = fps.count() * (len(_EVEN) + len(_ODD)) // 2
    buckets = partitions_for(spark, total, PER_TASK)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return (fps.select("fp").repartition(buckets)
            .mapInArrow(_emit(buckets), "bucket int, variant binary, code binary")
            .repartition(buckets, "bucket").mapInArrow(_meet, "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (long), component_id (smallest id reachable).

    Null texts count as empty, empty texts share fingerprint 0 and so one
    component; repeated ids give repeated rows; null ids take part in links but
    never name a component (it is null where no other id is in it).  Other
    columns are ignored; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    comp = connected_components(links(distinct))
    joined = distinct.join(comp.withColumnRenamed("node", "fp"), "fp")
    smallest = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(joined.join(smallest, "component").select("fp", "component_id"))
    label = (distinct.join(named, "fp", "left")
             .select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return marked.join(label, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (rows without an
    id last), then of the smallest digest of its text.

    Rows are told apart by id and text, so one id on two texts is two documents.  Of rows that repeat
    both, one stays, whichever of them; a null text counts as empty, and texts without words are one
    component.  An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, digest=True))
    found = materialize(marked.groupBy("id", "digest").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    distinct = materialize(found.groupBy("fp").agg(F.min(order).alias("low")))
    comp = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    joined = distinct.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = joined.groupBy("component").agg(F.min("low").alias("one"))
    label = joined.join(first, "component").select("fp", "one")
    judged = found.join(label, "fp").withColumn("stays", order.eqNullSafe(F.col("one")))
    # rows that need a look: those that go, and those that stay but repeat
    touched = materialize(judged.where("not stays or n > 1").select("id", "digest", "stays"))
    near_by = F.broadcast if touched.count() <= BROADCAST_ROWS else (lambda df: df)
    tagged = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"),
                         _text_digest(text_col).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_digest") == F.col("digest"))
    out = tagged.join(near_by(touched), same, "left_anti").select("_row.*")
    again = touched.where("stays")
    if again.isEmpty():
        return out
    once = tagged.join(near_by(again), same, "left_semi").dropDuplicates(["_id", "_digest"])
    return out.union(once.select("_row.*"))
