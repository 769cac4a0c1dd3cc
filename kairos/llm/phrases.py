"""Collocations: frequent phrases, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at sentence and clause marks and into
words at blanks and tabs.  Per language, phrases of up to four words that occur at least
``LEAST`` times are found in two passes.

Pass one hashes every occurrence of one to four words into hash partitions.  A task sorts
what it has and sends each partition its distinct hashes and their counts, an exact
summary; a partition's summaries are merged into one of Misra and Gries: counts are
added, and whenever more than k remain the (k+1)-th largest count is taken off all and
what is not above nought goes.  The partition's mass M arrives first, and k > M / LEAST, so
all taken off is less than LEAST: every frequent phrase survives, and a count is short by
no more than is known.  A partition's survivors set bits in its own part of a filter of
bounded size (32 MB at most, whatever the data), which is broadcast.

Pass two counts the occurrences that the filter lets through, by the phrase itself: the
counts are exact, and hashes that met by chance only cost work.  Every part of a frequent
phrase is as frequent, so the counts of all cuts are there too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize, mix, ngrams, partitions_for

#: Least occurrences, most words of a phrase.
LEAST, LONGEST = 30, 4
#: A phrase goes if a longer one has at least this share (percent) of its occurrences.
INSIDE = 80
TOP = 2000
#: Bits of a hash inside its partition; partitions per task; bytes of text for one merging task.
REST, SPLIT, TASK_BYTES = 28, 4, 12 << 20
#: Hashes that a task sorts at once, bytes and words that it counts at once (numbers of 21 bits), most bits of the filter.
FLUSH, GROUP, WORDS, MOST_BITS = 4 << 20, 3 << 20, 1_500_000, 1 << 28

_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
                         b"abcdefghijklmnopqrstuvwxyz " + _END * 10)


def _groups(batch):
    """(lang, text) with texts of a language joined, or parted where a piece ends, to about GROUP bytes."""
    by: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
        text = text.translate(_TABLE) if text else b""
        while len(text) > GROUP:
            cut = text.rfind(_END, 0, GROUP) if _END in text[:GROUP] else text.find(_END, GROUP)
            if cut <= 0:
                break
            yield lang, text[:cut]
            text = text[cut + 1:]
        if not text:
            continue
        by.setdefault(lang, []).append(text)
        size[lang] = size.get(lang, 0) + len(text)
        if size[lang] > GROUP:
            yield lang, _END.join(by.pop(lang))
            del size[lang]
    for lang, texts in by.items():
        yield lang, _END.join(texts)


def _segments(batches):
    """(lang, distinct words, numbers of the words, those that end a piece, starts) of joined texts."""
    for batch in batches:
        for lang, text in _groups(batch):
            words = text.replace(_END, b" " + _END + b" ").split()
            for s in range(0, len(words), WORDS):
                some = pa.array(words[s:s + WORDS + LONGEST - 1], pa.binary()).dictionary_encode()
                distinct, codes = some.dictionary.to_pylist(), some.indices.to_numpy()
                ends = np.zeros(len(distinct), bool)
                if _END in distinct:
                    ends[distinct.index(_END)] = True
                yield lang, distinct, codes, ends[codes], min(WORDS, len(codes))


def _hashes(lang: str, distinct: list[bytes], codes: np.ndarray, ends: np.ndarray, starts: int):
    """(n, places, hashes) of all n-word occurrences that begin at one of the first ``starts`` words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))[codes]
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    before = np.r_[0, np.cumsum(ends)]
    for n in range(1, LONGEST + 1):
        g = ngrams(h, n)[:starts]
        at = np.flatnonzero(before[n:n + len(g)] == before[:len(g)])
        yield n, at, mix(g[at] + salt)


def _keys(g: np.ndarray, parts: int) -> np.ndarray:
    """Partition above, rest of the hash below."""
    rest = g & np.uint64((1 << REST) - 1)
    return ((g >> np.uint64(REST)) % np.uint64(parts)) << np.uint64(REST) | rest


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    sums = np.diff(np.r_[cut, len(keys)]) if counts is None else np.add.reduceat(counts, cut) if len(cut) else counts
    return keys[cut], sums.astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, as the high ones are mostly nought."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


_SUMMARY = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("mass", pa.int64()), ("rest", pa.binary()),
                      ("count", pa.binary())])


def _summarise(parts: int):
    def flush(held):
        keys, counts = _counted(np.concatenate(held))
        # a count beyond 32 bits is told in several entries
        part = (keys >> np.uint64(REST)).astype(np.int64)
        rest = (keys & np.uint64((1 << REST) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
        rows = []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
            p = int(part[s])
            rows.append((p, 0, int(counts[s:e].sum()), None, None))
            rows.append((p, 1, None, _planes(np.diff(rest[s:e], prepend=0)), _planes(counts[s:e])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SUMMARY)], schema=_SUMMARY)

    def run(batches):
        held, n = [], 0
        for segment in _segments(batches):
            for _, _, g in _hashes(*segment):
                held.append(_keys(g, parts))
                n += len(g)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)
    return run


class MisraGries:
    """Summary of a partition of known mass: all keys that occur ``least`` times or more survive."""

    def __init__(self, mass: int, least: int):
        self.capacity, self.least, self.off = mass // least + 1, least, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self._held, self._n = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._held.append((keys, counts))
        self._n += len(keys)
        if self._n > max(self.capacity, 1 << 18):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self._held]])
        counts = np.concatenate([self.counts, *[c for _, c in self._held]])
        self.keys, self.counts = _counted(keys, counts)
        self._held, self._n = [], 0
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            taken = np.partition(self.counts, at)[at]
            left = self.counts > taken
            self.keys, self.counts = self.keys[left], self.counts[left] - taken
            self.off += int(taken)

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= self.least]


def _bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """Three places of a key among ``size`` bits."""
    x = mix(keys + np.uint64(1))
    y = mix(x)
    size = np.uint64(size)
    return [(z % size).astype(np.int64) for z in (x, y, mix(y))]


_FILTER = pa.schema([("part", pa.int32()), ("bits", pa.binary())])


def _merge(least: int, size: int):
    def done(part, summary):
        keys = summary.survivors().astype(np.uint64) | np.uint64(part) << np.uint64(REST)
        bits = np.zeros(size, np.uint8)
        for at in _bits(keys, size):
            bits[at] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()),
                                           pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())],
                                          schema=_FILTER)

    def run(batches):
        part, mass, summary = None, 0, None
        for batch in batches:
            for p, seq, m, rest, count in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if p != part:
                    if part is not None:
                        yield done(part, summary)
                    part, mass, summary = p, 0, None
                if not seq:
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass, least)
                summary.add(np.cumsum(_numbers(rest).astype(np.int64)), _numbers(count).astype(np.int64))
        if part is not None:
            yield done(part, summary)
    return run


_COUNTS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("phrase", pa.string()), ("c", pa.int64())])


def _count(parts: int, size: int, bits):
    """Counts of the phrases that the filter lets through, and all words of a language (n = 0)."""
    def hits(g):
        filled = np.frombuffer(bits.value, np.uint8)
        keys = _keys(g, parts)
        left, base = np.arange(len(keys)), (keys >> np.uint64(REST)).astype(np.int64) * size
        for at in _bits(keys, size):
            p = base[left] + at[left]
            left = left[(filled[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
        return left

    def run(batches):
        for segment in _segments(batches):
            lang, distinct, codes, ends, starts = segment
            total = int(starts - ends[:starts].sum())
            if not total:
                continue
            ns, phrases, counts = [0], [b""], [total]
            wide = codes.astype(np.int64)
            for n, at, g in _hashes(*segment):
                at = at[hits(g)]
                if not len(at):
                    continue
                if n < 4:
                    key = wide[at]
                    for k in range(1, n):
                        key = key << 21 | wide[at + k]
                    pairs = None
                else:  # numbers of the pairs of first words, as four numbers have too many bits
                    pairs, key = np.unique(wide[at] << 21 | wide[at + 1], return_inverse=True)
                    key = key << 42 | wide[at + 2] << 21 | wide[at + 3]
                key, c = _counted(key)
                low = (1 << 21) - 1
                if pairs is None:
                    columns = [(key >> 21 * k & low).tolist() for k in range(n - 1, -1, -1)]
                else:
                    first = pairs[key >> 42]
                    columns = [x.tolist() for x in (first >> 21, first & low, key >> 21 & low, key & low)]
                phrases += [b" ".join([distinct[i] for i in row]) for row in zip(*columns)]
                ns += [n] * len(key)
                counts += c.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(ns), pa.string()), pa.array(ns, pa.int32()),
                 pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], schema=_COUNTS)
    return run


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, f): exact counts of all phrases of n = 1 to 4 words that occur ``least`` times or
    more, and of all words of a language (n = 0, an empty phrase).

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they
    occur; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    configure(spark)
    lean = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").alias("text"))
    size = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions_for(spark, size, TASK_BYTES)
    parts = SPLIT * tasks
    # 16 bits for each phrase that could survive (two thirds of an occurrence per byte of text), up to the bound
    bits = max(64, min(MOST_BITS, 16 * size // least) // parts // 8 * 8)
    summaries = lean.mapInArrow(_summarise(parts), "part int, seq int, mass long, rest binary, count binary")
    filters = (summaries.repartition(tasks, "part").sortWithinPartitions("part", "seq")
               .mapInArrow(_merge(least, bits), "part int, bits binary"))
    whole = bytearray(parts * bits // 8)
    for r in filters.collect():  # parts of ``whole``
        whole[r["part"] * bits // 8:(r["part"] + 1) * bits // 8] = r["bits"]
    sent = spark.sparkContext.broadcast(bytes(whole))
    counts = lean.mapInArrow(_count(parts, bits, sent), "lang string, n int, phrase string, c long")
    kept = materialize(counts.groupBy("lang", "n", "phrase").agg(F.sum("c").alias("f"))
                       .where((F.col("f") >= least) | (F.col("n") == 0)))
    sent.destroy()
    return kept


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def score(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of ``frequent`` of two words or more, without those that
    lie inside a longer one that has ``INSIDE`` percent of their occurrences."""
    f = counts.where("n >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    phrases = counts.where("n >= 2").select("lang", "n", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = (phrases.select("lang", "n", "phrase", "a", "w", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"),
                    F.expr("array_join(slice(w, k + 1, n - k), ' ')").alias("right")))
    on = lambda side: (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))
    cuts = (cuts.join(f.withColumnRenamed("f", "l"), on("left")).drop("_lang", "_phrase")
            .join(f.withColumnRenamed("f", "r"), on("right")).drop("_lang", "_phrase"))
    value = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) "
                   "DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    scored = (cuts.withColumn("score", value).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("m")))
    inside = (phrases.where("n >= 3")
              .select("lang", "a", F.explode(F.expr(
                  "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), "
                  "s -> array_join(slice(w, s, m), ' '))))")).alias("_phrase"))
              .groupBy(F.col("lang").alias("_lang"), "_phrase").agg(F.max("a").alias("most")))
    kept = scored.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    kept = kept.where(F.col("most").isNull() | (100 * _exact("most") < INSIDE * _exact("a")))
    return kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def leading(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language with their rank: by score and a, descending, then phrase.

    Ranks are places inside range partitions plus the rows of the language before them."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(scored.repartitionByRange(parts, F.col("lang"), *order)
                         .withColumn("_p", F.spark_partition_id()))
    rows = placed.groupBy("lang", "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("lang").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(F.col("lang").alias("_lang"), F.col("_p").alias("_q"),
                       F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")).where(f"_before < {int(top)}")
    inside = F.row_number().over(Window.partitionBy("_p", "lang").orderBy(*order))
    return (placed.withColumn("_r", inside)
            .join(rows, (F.col("lang") == F.col("_lang")) & (F.col("_p") == F.col("_q")))
            .withColumn("rank", F.col("_before") + F.col("_r")).where(F.col("rank") <= top)
            .drop("_p", "_r", "_lang", "_q", "_before"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the leading phrases of each language.

    a is the phrase's count, l and r those of the two sides of its lowest-scoring cut (the first of
    equal ones), n all words of the language, score 2,000,000 a / (l + r), floored.  Rows are treated
    as ``frequent`` says."""
    counts = frequent(docs, lang_col, text_col, least)
    total = counts.where("n = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    first = leading(score(counts), top)
    return (first.join(F.broadcast(total) if total.count() <= 100_000 else total, F.col("lang") == F.col("_lang"))
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
