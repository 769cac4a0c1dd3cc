"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are looked for inside long documents, so the measure is
containment: the share of an item's distinct word shingles that a document has.
A plain MinHash comparison fails here (the Jaccard similarity of 30 shingles
with 20,000 is near zero), so items are partitioned by their number of shingles
q, and each partition gets a bottom-s MinHash sketch long enough for its largest
q: s = u - ceil(t * l) + 1 for l <= q <= u.  A document that contains a share t
of an item misses at most q - ceil(t * q) of its shingles, so it holds at least
one of the s smallest hashes: the sketch loses nothing, at any document length.
Documents are probed with one pass over their shingle hashes; those that hit a
sketch are verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import configure, hash_words, ngrams, words

SHINGLE = 5
CONTAINMENT = 0.8
#: Items are broadcast in blocks of at most so many bytes of text, one pass over the documents per block.
BLOCK_BYTES = 8 << 20
#: Size partitions: [1, 2), [2, 4), [4, 6), [6, 9), ... each upper end about 1.25 times the lower.
GROWTH = 1.25

PAIRS = "doc_id {0}, item_id {1}, shared long, item_shingles long, containment double"


def size_class(q: int) -> tuple[int, int]:
    """(smallest, largest) number of shingles in the partition of an item with q."""
    low = 1
    while True:
        high = max(low, math.ceil(low * GROWTH) - 1)
        if q <= high:
            return low, high
        low = high + 1


def sketch_length(q: int, t: float = CONTAINMENT) -> int:
    low, high = size_class(q)
    return min(q, high - math.ceil(t * low - 1e-9) + 1)


def _shingles(w: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)}


class _Block:
    """Sketches of a block of items, by shingle length (items under n words use their own length)."""

    def __init__(self, items: list[tuple], n: int, t: float):
        self.items, self.t, self.by_length = [], t, {}
        found: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            size = min(n, len(w))
            own = _shingles(w, size)
            hashes = np.unique(ngrams(hash_words(w), size))
            for h in hashes[:sketch_length(len(own), t)].tolist():
                found[size].append((h, len(self.items)))
            self.items.append((item_id, size, own))
        for size, pairs in found.items():
            pairs.sort()
            self.by_length[size] = (np.array([p[0] for p in pairs], np.uint64),
                                    np.array([p[1] for p in pairs], np.int64))

    def search(self, text: bytes | None) -> Iterator[tuple]:
        w = words(text)
        if not w:
            return
        h = hash_words(w)
        for size, (keys, owner) in self.by_length.items():
            grams = ngrams(h, size)
            if not len(grams):
                continue
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            hit = np.unique(grams[keys[at] == grams])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            candidates = np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi)]))
            mine = _shingles(w, size)
            for i in candidates.tolist():
                item_id, _, own = self.items[i]
                shared = len(own & mine)
                if shared >= self.t * len(own) - 1e-9:
                    yield item_id, shared, len(own)


def _blocks(items: DataFrame, limit: int) -> list[list[tuple]]:
    """Items in blocks of bounded size; only one block at a time is in the driver."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / limit * 1.5)) if total > limit else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in part.collect()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", n: int = SHINGLE,
                 t: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (doc_id, item_id, shared, item_shingles, containment) with containment of t or more.

    Words are lower-cased (A-Z).  Items under n words are one shingle, their whole
    word sequence; items without words match nothing; null and empty texts have no
    shingles.  Rows with a null id are searched like any other; repeated rows give
    repeated pairs.  An empty side gives no rows.
    """
    spark = docs.sparkSession
    configure(spark)
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    bench = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    doc_type = lean.schema["id"].dataType.simpleString()
    item_type = bench.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(bench, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = _Block(sent.value, n, t)
            for b in batches:
                got = [(i, *r) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                       for r in search.search(x)]
                cols = list(zip(*got)) if got else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], b.schema.types[0]), pa.array(cols[1], item_arrow), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int64()),
                     pa.array([s / q for s, q in zip(cols[2], cols[3])], pa.float64())],
                    names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        item_arrow = pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()
        pairs = lean.mapInArrow(run, PAIRS.format(doc_type, item_type))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", n: int = SHINGLE, t: float = CONTAINMENT,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no item (see ``contaminated``).

    Every row is judged on its own text, so null or repeated ids need no rule; nothing is shuffled."""
    spark = docs.sparkSession
    configure(spark)
    bench = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"))
    at = docs.columns.index(text_col)
    for block in _blocks(bench, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = _Block(sent.value, n, t)
            for b in batches:
                texts = b.column(at).cast(pa.binary()).to_pylist()
                yield b.filter(pa.array([next(search.search(x), None) is None for x in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
