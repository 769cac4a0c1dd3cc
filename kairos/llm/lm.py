"""Language-model scores from a log-frequency Bloom filter.

Bigrams and words of the training documents are counted by hash bucket; a count c
is quantised to the level 1 + floor(log2 c), and (n-gram, 1) .. (n-gram, level) go
into the bucket's segment of a Bloom filter (Talbot and Osborne 2007).  The
segments are broadcast; a worker reads a count back by probing level after level
until one is absent, and smooths bigrams with Dirichlet weight toward words:

    p(w | h) = (c(h, w) + MU p(w)) / (max(c(h), c(h, w)) + MU)

Whatever the corpus, a broadcast is bounded: at most SLICE_BYTES of filter, one
slice per pass over the documents when there is more (histories are dealt to
slices, so each token is scored in exactly one pass), and at most HEAD frequent
words with exact counts.  The words outside this head meet their exact counts in a
shuffle, with the levels of their bigram and history, and are scored there: p(w) comes
from the count of every word, and no score hangs on the size of the head.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import blob_rows, configure, hash_words, materialize, mix, partitions_for, words

FOLDS, HELD_OUT = 5, 1
MU = 32.0
ENTRY_BITS, PROBES = 8, 5
SLICE_BYTES = 64 << 20
HEAD = 400_000
#: Tokens that a training task holds before it adds up equal n-grams, and tokens per count bucket.
BUFFER, PER_BUCKET = 3_000_000, 1_500_000

_START = np.uint64(xxhash.xxh64_intdigest(b"<start>", 1))
_END = np.uint64(xxhash.xxh64_intdigest(b"<end>", 2))
_LEVEL = 0xD1B54A32D192ED03
_U32 = np.uint64(0xFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text (null: empty) leaves remainder HELD_OUT."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends, of the token before each, and where each text starts."""
    tok, start, n = [], [], 0
    for t in texts:
        h = hash_words(words(t))
        start.append(n)
        n += len(h) + 1
        tok += [h, [_END]]
    tok = np.concatenate(tok).astype(np.uint64) if tok else np.empty(0, np.uint64)
    start = np.array(start, np.int64)
    prev = np.empty_like(tok)
    prev[1:] = tok[:-1]
    prev[start] = _START
    return tok, prev, start


def bigram(prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(mix(prev) + tok)


def bucket_of(history: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(history) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def level_count(level: np.ndarray) -> np.ndarray:
    """Mean count of a level: 0, 1, 2.5, 5.5, ..."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def _positions(key: np.ndarray, level, bits: np.ndarray) -> Iterator[np.ndarray]:
    m = mix(key + np.uint64(level * _LEVEL & 0xFFFFFFFFFFFFFFFF))
    a, b = m & _U32, (m >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (a + np.uint64(i) * b) % bits


def build_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter words (uint64) with an entry for every level of every key."""
    lv = levels(counts)
    size = max(1, -(-int(lv.sum()) * ENTRY_BITS // 64))
    seg, bits = np.zeros(size, np.uint64), np.uint64(size * 64)
    for level in range(1, int(lv.max(initial=0)) + 1):
        k = keys[lv >= level]
        for p in _positions(k, level, bits):
            np.bitwise_or.at(seg, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
    return seg


class Filter:
    """Segments of the buckets of one slice; probes give levels."""

    def __init__(self, buckets: int, segments: list[tuple[int, bytes]]):
        self.buckets = buckets
        self.bits = np.zeros(buckets, np.uint64)
        self.at = np.zeros(buckets, np.uint64)
        n = 0
        for b, s in segments:
            self.bits[b], self.at[b] = len(s) * 8, n * 64
            n += len(s) // 8
        self.words = np.frombuffer(b"".join(s for _, s in segments), np.uint64)

    def level(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        live = np.flatnonzero(self.bits[bucket] > 0)
        bits, at = self.bits[bucket], self.at[bucket]
        level = 0
        while len(live) and level < 64:
            level += 1
            k, base = key[live], at[live]
            ok = np.ones(len(live), bool)
            for p in _positions(k, level, bits[live]):
                p = p + base
                ok &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
            live = live[ok]
            out[live] = level
        return out


def _sum_equal(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[cut], np.add.reduceat(counts, cut) if len(cut) else counts


_PARTIAL = "bucket int, gram int, keys binary, counts binary"


def _partial_counts(buckets: int):
    def flush(toks, prevs, docs):
        tok, prev = np.concatenate(toks), np.concatenate(prevs)
        u, c = np.unique(tok, return_counts=True)
        u, c = np.append(u, _START), np.append(c, docs)
        rows = [(b, 1, *x) for b, x in blob_rows(bucket_of(u, buckets), [u, c.astype(np.int64)], buckets)]
        gram = bigram(prev, tok)
        order = np.argsort(gram)
        gram, prev = gram[order], prev[order]
        cut = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        c = np.diff(np.append(cut, len(gram))).astype(np.uint32)
        rows += [(b, 2, *x) for b, x in blob_rows(bucket_of(prev[cut], buckets), [gram[cut], c], buckets)]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                           pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                          names=["bucket", "gram", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks, prevs, n, docs = [], [], 0, 0
        for b in batches:
            tok, prev, start = _tokens(b.column(0).to_pylist())
            toks.append(tok)
            prevs.append(prev)
            n, docs = n + len(tok), docs + len(start)
            if n >= BUFFER:
                yield flush(toks, prevs, docs)
                toks, prevs, n, docs = [], [], 0, 0
        if n:
            yield flush(toks, prevs, docs)
    return run


_COUNTED = ("bucket int, keys binary, counts binary, tokens long, types long, hist array<long>, "
            "segment binary")


def _whole_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: exact word counts, their numbers by level, and the filter segment of words and bigrams."""
    held: dict[int, dict[int, list]] = {}
    for b in batches:
        for bucket, gram, k, c in zip(*(x.to_pylist() for x in b.columns)):
            held.setdefault(bucket, {1: [], 2: []})[gram].append(
                (np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64 if gram == 1 else np.uint32)))
    for bucket in sorted(held):
        parts = held.pop(bucket)
        k1, c1 = _sum_equal(np.concatenate([x[0] for x in parts[1]] or [np.empty(0, np.uint64)]),
                            np.concatenate([x[1] for x in parts[1]] or [np.empty(0, np.int64)]))
        k2, c2 = _sum_equal(np.concatenate([x[0] for x in parts[2]] or [np.empty(0, np.uint64)]),
                            np.concatenate([x[1] for x in parts[2]] or [np.empty(0, np.uint32)]).astype(np.int64))
        segment = build_segment(np.concatenate([k1, k2]), np.concatenate([c1, c2]))
        word = k1 != _START
        k1, c1 = k1[word], c1[word]
        lv = levels(c1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([k1.tobytes()], pa.binary()),
             pa.array([c1.tobytes()], pa.binary()), pa.array([int(c1.sum())], pa.int64()),
             pa.array([len(k1)], pa.int64()), pa.array([np.bincount(lv, minlength=64).tolist()], pa.list_(pa.int64())),
             pa.array([segment.tobytes()], pa.binary())],
            names=["bucket", "keys", "counts", "tokens", "types", "hist", "segment"])


class Model:
    """Counts in the shared folder and the bounded parts that scoring broadcasts."""

    def __init__(self, counted: DataFrame, buckets: int):
        self.counted, self.buckets = counted, buckets
        t = counted.agg(F.sum("tokens"), F.sum("types"),
                        *[F.sum(F.get("hist", F.lit(i))) for i in range(64)]).first()
        self.tokens, self.types = t[0] or 0, t[1] or 0
        hist = [x or 0 for x in t[2:]]
        self.level = next(i for i in range(1, 65) if sum(hist[i:]) <= HEAD)
        self.scale = self.tokens + 0.5 * (self.types + 1)

    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of at least the head's level with their counts, sorted; at most HEAD."""
        level = self.level

        def run(batches):
            for b in batches:
                out = []
                for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    k, c = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                    top = levels(c) >= level
                    out.append((k[top].tobytes(), c[top].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)],
                                                 names=["keys", "counts"])

        rows = self.counted.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").collect()
        k = np.frombuffer(b"".join(r[0] for r in rows), np.uint64)
        c = np.frombuffer(b"".join(r[1] for r in rows), np.int64)
        order = np.argsort(k)
        return k[order], c[order]

    def slices(self) -> list[list[int]]:
        """Buckets of each slice of the filter."""
        sizes = self.counted.select("bucket", F.octet_length("segment")).orderBy("bucket").collect()
        out, room = [[]], SLICE_BYTES
        for b, n in sizes:
            if n > room and out[-1]:
                out.append([])
                room = SLICE_BYTES
            out[-1].append(b)
            room -= n
        return out

    def slice(self, buckets: list[int]) -> Filter:
        low, high = (buckets[0], buckets[-1]) if buckets else (0, -1)
        rows = self.counted.where(F.col("bucket").between(low, high)).select("bucket", "segment").collect()
        return Filter(self.buckets, [(r[0], bytes(r[1])) for r in rows])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Model of all rows of ``docs``; null texts are empty, every text ends in one end token."""
    spark = docs.sparkSession
    configure(spark)
    text = docs.select(F.col(text_col).cast("binary").alias("t"))
    size = text.agg(F.sum(F.octet_length("t") + 1)).first()[0] or 0
    buckets = partitions_for(spark, size / 6, PER_BUCKET)
    counted = (text.mapInArrow(_partial_counts(buckets), _PARTIAL).repartition(buckets, "bucket")
               .mapInArrow(_whole_counts, _COUNTED))
    return Model(materialize(counted), buckets)


_SCORED = ("rid long, id {0}, n_tokens long, n_known long, base double, score double, "
           "bucket int, keys binary, tf binary, owner binary, pair binary")
_NAMES = [x.split()[0] for x in _SCORED.split(", ")]


def _log_score(l2: np.ndarray, lh: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """log10 p(w | h) from the levels of the bigram and the history and from p(w)."""
    c2 = level_count(l2)
    return np.log10((c2 + MU * p1) / (np.maximum(level_count(lh), c2) + MU))


def _scorer(model: Model, head, filt, first: bool):
    buckets, scale = model.buckets, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hk, hc = head.value
        f = filt.value
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tok, prev, start = _tokens(b.column(2).to_pylist())
            if not len(rid):
                continue
            n = np.diff(np.append(start, len(tok)))
            doc = np.repeat(np.arange(len(rid)), n)
            u, inv = np.unique(tok, return_inverse=True)
            at = np.minimum(np.searchsorted(hk, u), max(0, len(hk) - 1))
            known = hk[at] == u if len(hk) else np.zeros(len(u), bool)
            c1 = np.where(known, hc[at] if len(hk) else 0, 0).astype(np.float64)
            p1 = ((c1 + 0.5) / scale)[inv]
            top = known[inv]
            hu, hinv = np.unique(prev, return_inverse=True)
            hb = bucket_of(hu, buckets)
            mine = (f.bits[hb] > 0)[hinv]
            if first:   # histories without a bucket in any slice were never seen: scored in the first pass
                mine |= (model_bits == 0)[hb][hinv]
            lh = f.level(hu, hb)[hinv]
            score = np.zeros(len(tok))
            i = np.flatnonzero(mine)
            l2 = f.level(bigram(prev[i], tok[i]), hb[hinv[i]])
            j = top[i]
            score[i[j]] = _log_score(l2[j], lh[i[j]], p1[i[j]])
            zero = np.zeros(len(rid))
            if first:
                base = np.bincount(doc, np.where(top, np.log10(p1), 0.0), len(rid))
                seen = np.bincount(doc, top, len(rid)).astype(np.int64)
            else:
                base, seen = zero, zero.astype(np.int64)
            null = pa.nulls(len(rid), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), b.column(1), pa.array(n if first else seen), pa.array(seen), pa.array(base),
                 pa.array(np.bincount(doc, score, len(rid))), pa.nulls(len(rid), pa.int32()), null, null, null, null],
                names=_NAMES)
            i, l2 = i[~j], l2[~j]
            if len(i):     # words outside the head: one entry per text, word and levels, in the token's own pass
                pair = (l2 << 8 | lh[i]).astype(np.uint16)
                order = np.lexsort((pair, tok[i], doc[i]))
                i, pair = i[order], pair[order]
                d, w = doc[i], tok[i]
                cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (pair[1:] != pair[:-1])])
                tf = np.diff(np.append(cut, len(i))).astype(np.uint32)
                rows = list(blob_rows(bucket_of(w[cut], buckets), [w[cut], tf, rid[d[cut]], pair[cut]], buckets))
                k = len(rows)
                blob = [pa.array([r[1][c] for r in rows], pa.binary()) for c in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64()), pa.nulls(k, b.schema.types[1]), *[pa.nulls(k, pa.int64())] * 2, *[pa.nulls(k, pa.float64())] * 2,
                     pa.array([r[0] for r in rows], pa.int32()), *blob],
                    names=_NAMES)

    model_bits = model.bucket_bytes
    return run


def _rare_scores(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, tuple] = {}
        asked: dict[int, list] = {}
        for b in batches:
            for bucket, k, c, owner, pair in zip(*(x.to_pylist() for x in b.columns)):
                if owner is None:
                    table[bucket] = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                else:
                    asked.setdefault(bucket, []).append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.uint32),
                                                         np.frombuffer(owner, np.int64),
                                                         np.frombuffer(pair, np.uint16)))
        for bucket in sorted(asked):
            key, tf, owner, pair = (np.concatenate(x) for x in zip(*asked.pop(bucket)))
            keys, counts = table.get(bucket, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            c = np.zeros(len(key))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                c = np.where(keys[at] == key, counts[at], 0).astype(np.float64)
            o, inv = np.unique(owner, return_inverse=True)
            p1, pair = (c + 0.5) / scale, pair.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o), pa.array(np.bincount(inv, tf * (c > 0), len(o)).astype(np.int64)),
                 pa.array(np.bincount(inv, tf * np.log10(p1), len(o))),
                 pa.array(np.bincount(inv, tf * _log_score(pair >> 8, pair & 255, p1), len(o)))],
                names=["rid", "known", "logs", "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Null and empty texts have one token, the end.  Rows are told apart by position,
    so null and repeated ids are scored like any other; an empty table gives no rows.
    Words are compared by 64-bit hash.
    """
    spark = docs.sparkSession
    configure(spark)
    lean = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("binary").alias("t"))
    schema = _SCORED.format(lean.schema["id"].dataType.simpleString())
    head = spark.sparkContext.broadcast(model.head())
    sizes = np.zeros(model.buckets, np.int64)
    for b, n in model.counted.select("bucket", F.octet_length("segment")).collect():
        sizes[b] = n
    model.bucket_bytes = sizes
    slim = Model.__new__(Model)
    slim.__dict__ = {k: v for k, v in model.__dict__.items() if k != "counted"}
    parts = None
    for i, buckets in enumerate(model.slices()):
        filt = spark.sparkContext.broadcast(model.slice(buckets))
        part = materialize(lean.mapInArrow(_scorer(slim, head, filt, i == 0), schema))
        filt.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    asked = parts.where("bucket is not null").select("bucket", "keys", F.col("tf").alias("counts"), "owner", "pair")
    counted = model.counted.select("bucket", "keys", "counts",
                                   *[F.lit(None).cast("binary").alias(c) for c in ("owner", "pair")])
    rare = (asked.unionByName(counted).repartition(model.buckets, "bucket")
            .mapInArrow(_rare_scores(model.scale), "rid long, known long, logs double, score double")
            .select("rid", F.lit(None).cast(lean.schema["id"].dataType).alias("id"),
                    F.lit(0).cast("long").alias("n_tokens"), F.col("known").alias("n_known"),
                    F.col("logs").alias("base"), "score"))
    whole = (parts.where("rid is not null").select("rid", "id", "n_tokens", "n_known", "base", "score")
             .unionByName(rare).groupBy("rid").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")]))
    return whole.select(
        "id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score")
