"""Periodic runs of words, found in scale-tiled form.

A run is a maximal stretch of words with smallest period q, at least ``LEAST``
words and three periods long.  In terms of matches (word i equals word i + q) it
is a stretch of at least max(24 - q, 2 q) positions, so that it holds a whole
aligned block of S words: S = 8 for the periods 1 to 15, S = 2^k * 8 for those of
octave k, from S to 2 S - 1.

A text is exploded into overlapping tiles per octave.  A tile is a series of
neighbouring blocks with S words before it and 2 S words and one period behind;
each block start is a boundary.  The Z-function of what follows the boundary says
how far the words repeat to the right at every period of the octave, the one of
what precedes it, reversed, how far to the left.  Tiles are dealt out by
(document, octave, place) and solved alone, so a long text is no long task;
their fragments meet again by (document, period) and are stitched where they
touch.  A fragment with a multiple of the smallest period covers the same words
as that one and goes.

Only blocks that can match are tiled: in a whole block each eight-word window
recurs within the longest period of the octave.  That is a condition of every
run (equal words have equal hashes), so nothing is lost, and a text without
repeated windows makes no tile at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize, mix, partitions_for

#: Least words and least periods of a run.
LEAST, TIMES = 24, 3
#: Words of the window that must recur, and least block.
WINDOW = 8
#: Words of a tile without its margins; at least four blocks.
TILE = 1024
#: Bytes of tiles for one solving task, and of rows for one Arrow batch.
TASK_BYTES, BATCH_BYTES = 4 << 20, 8 << 20
#: Longest distance, for a window that does not recur.
FAR = np.int64(1) << 62


def octave_of(k: int) -> tuple[int, int, int]:
    """(least period, least period of the next octave, block) of octave k."""
    s = WINDOW << k
    return (1 if k == 0 else s), 2 * s, s


def z_function(s: list[int]) -> list[int]:
    """z[i]: length of the longest common prefix of s and s[i:]; z[0] is left 0."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _recurrence(ids: np.ndarray) -> np.ndarray | None:
    """Distance of each eight-word window to its next occurrence; None where none recurs."""
    if len(ids) < LEAST:
        return None
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):
        h = mix(mix(h[:-step]) + h[step:])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return None
    gap = np.full(len(h), FAR)
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return gap


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(octave, first boundary, number of boundaries, words from S before the first) of a text."""
    gap = _recurrence(ids)
    if gap is None:
        return
    n, k = len(ids), 0
    while octave_of(k)[0] <= n // TIMES:
        low, high, s = octave_of(k)
        at = np.arange(0, max(0, n - s - low + 1), s)
        far = np.r_[0, np.cumsum(gap >= high)]
        at = at[far[at + s - WINDOW + 1] == far[at]]
        most = max(4, TILE // s)
        if len(at):
            for series in np.split(at, np.flatnonzero(np.diff(at) != s) + 1):
                for i in range(0, len(series), most):
                    c = series[i:i + most]
                    yield k, int(c[0]), len(c), ids[max(0, c[0] - s):c[-1] + 2 * s + high]
        k += 1


def solve(k: int, first: int, count: int, words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the stretches of matches around a tile's boundaries."""
    low, high, s = octave_of(k)
    open_: dict[int, list[int]] = {}
    base = max(0, first - s)
    for b in range(first - base, first - base + count * s, s):
        right = z_function(words[b:b + 2 * s + high])
        hits = [q for q in range(low, min(high, len(right))) if right[q] >= s]
        if not hits:
            continue
        before = words[max(0, b - s):b][::-1]
        left = z_function(before + [-1] + words[max(0, b - s):b + high][::-1])
        top = len(before) + 1 + min(high, len(words) - b)
        for q in hits:
            back = left[top - q] if top - q < len(left) else 0
            start, end = base + b - back, base + b + min(right[q], 2 * s)
            got = open_.get(q)
            if got and start <= got[1]:
                got[1] = max(got[1], end)
            else:
                if got:
                    yield q, got[0], got[1]
                open_[q] = [start, end]
    for q, (start, end) in open_.items():
        yield q, start, end


def _text_schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("id", id_type), ("n", pa.int64()), ("words", pa.string()),
                      ("sha", pa.string()), ("octave", pa.int32()), ("first", pa.int64()), ("boundaries", pa.int32()),
                      ("tile", pa.binary())])


def _explode(batches):
    """A row per text, and one per tile of it; a text without tiles gets its digest here."""
    key = TaskContext.get().partitionId() << 33
    for batch in batches:
        schema = _text_schema(batch.schema.field("id").type)
        rows, size = [], 0
        for id_, text in zip(batch.column("id"), batch.column("text").cast(pa.binary()).to_pylist()):
            words = text.split() if text else []
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            joined, tiled = b" ".join(words), False
            for k, first, count, tile in tiles(ids):
                tiled = True
                rows.append((key, None, None, None, None, k, first, count, tile.tobytes()))
                size += 4 * len(tile)
                if size > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            rows.append((key, id_.as_py(), len(words), joined.decode() if tiled else None,
                         None if tiled else hashlib.sha256(joined).hexdigest(), None, None, None, None))
            size += len(joined) if tiled else 100
            if size > BATCH_BYTES:
                yield _batch(rows, schema)
                rows, size = [], 0
            key += 1
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _solve(batches):
    schema = pa.schema([("key", pa.int64()), ("period", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            words = np.frombuffer(r["tile"], np.int32).tolist()
            for q, s, e in solve(r["octave"], r["first"], r["boundaries"], words):
                rows.append((r["key"], q, s, e))
            if len(rows) > 100_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _collapse(batches):
    """Words that no run repeats, joined by one space."""
    for batch in batches:
        schema = pa.schema([("id", batch.schema.field("id").type), ("n", pa.int64()),
                            ("runs", batch.schema.field("runs").type), ("collapsed", pa.string()),
                            ("sha", pa.string())])
        texts, shas = [], []
        for joined, runs in zip(batch.column("words").cast(pa.binary()).to_pylist(),
                                batch.column("runs").to_pylist()):
            if runs:
                words = joined.split(b" ")
                step = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    step[r["start"] + r["period"]] += 1
                    step[r["start"] + r["length"]] -= 1
                kept = np.cumsum(step[:-1]) == 0
                joined = b" ".join([w for w, k in zip(words, kept.tolist()) if k])
            texts.append(joined.decode() if runs else None)
            shas.append(hashlib.sha256(joined).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n"), batch.column("runs"), pa.array(texts, pa.string()),
             pa.array(shas, pa.string())], schema=schema)


RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, runs) of fragments (key, period, s, e) that may overlap, touch or repeat."""
    order = Window.partitionBy("key", "period").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= F.col("before"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    whole = (fragments.withColumn("before", before).withColumn("island", island)
             .groupBy("key", "period", "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
             .withColumn("length", F.col("e") - F.col("start") + F.col("period"))
             .where((F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))))
    return (whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
            .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs")))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed, collapsed_sha256) for every row of ``docs``.

    ``runs`` is an array of (start, period, length) by start, then period.  ``collapsed``
    is the text without the repeats, its words joined by one space, where a run was
    found, else null (the text stays as it is); its SHA-256 is given in either case.
    Null and empty texts have no words and no run; null and repeated ids are fine, as
    every row is a text of its own; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    configure(spark)
    lean = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = lean.schema["id"].dataType.simpleString()
    # written once: the keys of texts are numbers of this pass
    rows = materialize(lean.mapInArrow(
        _explode, f"key long, id {id_type}, n long, words string, sha string, octave int, first long, boundaries int, "
                  "tile binary"))
    tile = rows.where("octave is not null").select("key", "octave", "first", "boundaries", "tile")
    size = tile.agg(F.sum(F.octet_length("tile"))).first()[0] or 0
    dealt = tile.repartition(partitions_for(spark, size, TASK_BYTES), "key", "octave", "first")
    runs = stitch(dealt.mapInArrow(_solve, "key long, period long, s long, e long"))
    texts = rows.where("octave is null").select("key", "id", "n", "words", "sha")
    none = F.array().cast(RUNS)
    tiled = (texts.where("sha is null").select("key", "id", "n", "words").join(runs, "key", "left")
             .select("id", "n", "words", F.coalesce("runs", none).alias("runs"))
             .mapInArrow(_collapse, f"id {id_type}, n long, runs {RUNS}, collapsed string, sha string"))
    plain = texts.where("sha is not null").select("id", "n", none.alias("runs"),
                                                  F.lit(None).cast("string").alias("collapsed"), "sha")
    return (plain.unionByName(tiled).withColumnRenamed("n", "n_words")
            .withColumnRenamed("sha", "collapsed_sha256"))
