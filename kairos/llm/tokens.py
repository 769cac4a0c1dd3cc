"""Token ids as Parquet list columns, for selective token and metadata reads.

A token table is a folder with ``ids`` (one row per document in ascending id
order over files by name: file, offset, id, n_tokens, ids) and ``index`` (one row
per file: rows, tokens, first token).  The list column is dictionary-coded
(indices of as many bits as the file's vocabulary needs) or delta-coded; the
numbers beside it are always delta-coded.  Row groups are bounded in bytes and
pages in rows, and every column chunk has its column and offset index, so a read
by id or of metadata alone touches few pages.  Spark's own writer and reader do
the work.

Documents are dealt out by id ranges and sorted inside a file; a document's place
among all tokens is its file's first token, from the index, plus its offset.

Texts are encoded word by word: the pre-tokenizer never joins what stands before
a space to what follows when a non-space precedes it, so a word's ids don't
depend on its neighbours.  Words met before come from a bounded cache, new ones
go to the tokenizer joined into one text; texts with other runs of white space
before a space go to it as they are.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairos.llm.common import configure, partitions_for
from kairos.session import checkpoint_dir

#: Id that ends each document.
END = 0
#: Bytes of text per file, bytes per row group and page, rows per page.
FILE_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 16 << 20, 64 << 10, 1000
#: Bytes of text encoded at once, words that stay known to a worker, longest word that joins others.
BATCH_BYTES, CACHED, PIECE = 8 << 20, 500_000, 64
#: New words joined for one call of the tokenizer.
JOINED = 500
#: An index of at most this many files (a few MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_FILES = 100_000

#: White space of the pre-tokenizer (or more) before a space: there a cut would part what belongs together.
_AFTER_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")
_MARKS = ".,;:!?"


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library, without special tokens.

    The strings of special tokens in a text are ordinary text.  A batch of texts becomes a series
    of entries (words after a space, first words, end ids), and the ids of all entries are gathered
    at once.  Up to ``CACHED`` words that recur stay known; others are encoded for their batch."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self._t = Tokenizer.from_file(path)
        self._t.encode_special_tokens = True
        # a space and letters alone are one piece of the pattern, so letters need none
        self._letters = Tokenizer.from_file(path)
        self._letters.encode_special_tokens = True
        self._letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self._t.get_vocab()
        self._length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self._length[i] = len(token)  # one character stands for one byte
        self._ids, self._at, self._n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self._after: dict[str, int] = {}
        self._mark = {}
        self._put([np.array([end], np.uint32)])
        for m in _MARKS:
            self._mark[m] = self.whole(m)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _put(self, parts: list[np.ndarray]) -> int:
        """Append an entry for each part; the number of the first."""
        return self._put_flat(np.concatenate(parts), np.array([len(p) for p in parts], np.int64))

    def _put_flat(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        n, top = self._n, int(self._at[self._n])
        while n + len(lengths) + 1 > len(self._at):
            self._at = np.r_[self._at, np.zeros_like(self._at)]
        while top + len(ids) > len(self._ids):
            self._ids = np.r_[self._ids, np.zeros_like(self._ids)]
        self._ids[top:top + len(ids)] = ids
        self._at[n + 1:n + 1 + len(lengths)] = top + np.cumsum(lengths)
        self._n = n + len(lengths)
        return n

    def _learn(self, words: list[str], tokenizer, known: dict[str, int]) -> None:
        """Entries of ' ' + word, for distinct words that end in no white space."""
        for i in range(0, len(words), JOINED):
            some = words[i:i + JOINED]
            ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids,
                           np.uint32)
            at = np.cumsum(self._length[ids])
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            cut = np.searchsorted(at, ends) + 1
            if cut[-1] != len(at) or not (at[cut - 1] == ends).all():
                raise ValueError("this tokenizer joins words across a space")
            first = self._put_flat(ids, np.diff(cut, prepend=0))
            known.update(zip(some, range(first, first + len(some))))

    def _entries(self, words: list[str], extra: dict[str, int]) -> np.ndarray:
        """Entry of ' ' + word for distinct words; ``extra`` takes those that the batch adds."""
        got = list(map(self._after.get, words))
        new = [w for w, e in zip(words, got) if e is None]
        if new:
            letters, marked, plain, odd = set(), [], [], []
            for w in new:
                if w.isalpha() and len(w) <= PIECE:
                    letters.add(w)
                elif not w or w[-1].isspace() or len(w) > PIECE:
                    odd.append(w)
                elif w[-1] in _MARKS and w[:-1].isalpha():
                    marked.append(w)
                else:
                    plain.append(w)
            letters.update(w[:-1] for w in marked if w[:-1] not in self._after)
            self._learn(list(letters), self._letters, extra)
            self._learn(plain, self._t, extra)
            if odd or marked:
                parts = [self.whole(" " + w) for w in odd]
                for w in marked:
                    e = self._after.get(w[:-1])
                    e = extra[w[:-1]] if e is None else e
                    parts.append(np.concatenate((self._ids[self._at[e]:self._at[e + 1]], self._mark[w[-1]])))
                extra.update(zip(odd + marked, range(first := self._put(parts), first + len(parts))))
            got = [extra[w] if e is None else e for w, e in zip(words, got)]
        return np.array(got, np.int64)

    def _keep(self, n: int, words: list[str], extra: dict[str, int], known: dict[str, int]) -> None:
        """Forget the entries from ``n`` on, but for those of ``words`` if they still fit into the cache."""
        words = words[:max(0, CACHED - len(self._after))]
        parts = [self._ids[self._at[e]:self._at[e + 1]].copy() for e in map(extra.get, words)]
        self._n = n
        if words:
            known.update(zip(words, range(first := self._put(parts), first + len(parts))))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); each text ends in the end id."""
        keep_n, extra = self._n, {}
        odd = pc.match_substring_regex(texts, _AFTER_SPACE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        at = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes, first = words.indices.to_numpy(), at[:-1] - at[0]
        distinct = words.dictionary.to_pylist()
        place = self._entries(distinct, extra)[codes]
        # first words have no space before them, odd texts are one entry
        heads = words.take(pa.array(first)).cast(pa.string()).to_pylist()
        alone = list(dict.fromkeys(heads))
        parts = [np.array(e.ids, np.uint32) for e in self._t.encode_batch_fast(alone, add_special_tokens=False)]
        entry = dict(zip(alone, range(n := self._put(parts), n + len(parts))))
        heads = [entry[w] for w in heads]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            pieces = _CUT.split(text) if len(text) > 1 << 20 else [text]
            heads[i] = self._put([np.concatenate([self.whole(p) for p in pieces])])
        place[first] = heads
        place = np.insert(place, at[1:] - at[0], 0)
        lengths = self._at[place + 1] - self._at[place]
        ends = np.cumsum(lengths)
        small = np.int32 if max(ends[-1], self._at[self._n]) < 1 << 30 else np.int64
        at_word = np.repeat((self._at[place] - ends + lengths).astype(small), lengths)
        at_word += np.arange(ends[-1], dtype=small)
        ids = self._ids[at_word]
        counts = np.diff(ends[at[1:] - at[0] + np.arange(len(texts))], prepend=0)
        often = [w for w, n in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist()) if n > 1 and w in extra]
        self._keep(keep_n, often, extra, self._after)
        return ids, counts


@lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def _rows(path: str, end: int, id_type: pa.DataType):
    schema = pa.schema([("file", pa.int32()), ("offset", pa.int64()), ("id", id_type), ("n_tokens", pa.int32()),
                        ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder, file, offset = _encoder(path, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(texts):
                before = size[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(size, before + BATCH_BYTES)))
                ids, n = encoder.encode(texts.slice(start, stop - start))
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)),
                                                 pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), file, np.int32)), pa.array(offset + ends - n),
                     batch.column("id").slice(start, stop - start), pa.array(n.astype(np.int32)), lists],
                    schema=schema)
                offset += int(ends[-1])
                start = stop
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 encoding: str = "dictionary", end: int = END) -> None:
    """Encode every text of ``docs`` and write the token table ``path``.

    Rows are in ascending id order (nulls first, equal ids by text); ``encoding`` of the list
    column is "dictionary" or "delta".  A null text is empty: one end id.  Repeated rows are
    written as often as they occur; an empty table gives an empty token table; other columns
    are not read.  ``tokenizer`` is a path that every worker can open.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    spark = docs.sparkSession
    configure(spark)
    lean = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = lean.schema["id"].dataType
    # the reading task spreads rows that are equal in id and text, should they be many
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("part")]
    ranged = lean.withColumn("part", F.spark_partition_id()).repartitionByRange(partitions_for(spark, size, FILE_BYTES), *order).sortWithinPartitions(*order)
    ranged = ranged.drop("part")
    id_type = pa.int64() if kind.simpleString() == "bigint" else _arrow_type(lean.select("id"))
    encoded = ranged.mapInArrow(_rows(tokenizer, end, id_type),
                                f"file int, offset long, id {kind.simpleString()}, n_tokens int, ids array<int>")
    (encoded.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "false")
     .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
     .parquet(f"{path}/ids"))
    files = (spark.read.parquet(f"{path}/ids").groupBy("file")
             .agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens")))
    first = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files.withColumn("first", F.coalesce(first, F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/index")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema["id"].dataType)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of a token table; only the columns selected from it are read."""
    index = spark.read.parquet(f"{path}/index").select(F.col("file").alias("_file"), "first")
    if index.count() <= BROADCAST_FILES:
        index = F.broadcast(index)
    return (spark.read.parquet(f"{path}/ids").join(index, F.col("file") == F.col("_file"))
            .select("id", (F.col("first") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long"), "ids"))


def _sums(batches):
    for batch in batches:
        lists = batch.column("ids")
        at, raw = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        columns = [batch.column(c) for c in ("id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, crc32) of the rows of ``read_tokens``: CRC-32 of the ids as little-endian 32-bit."""
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(_sums, f"id {kind}, start long, n_tokens long, crc32 long")


def scratch(spark: SparkSession) -> str:
    """A new folder for a token table beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
