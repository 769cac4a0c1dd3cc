"""Token tables: exact round trips, the layout of the files, odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairos.llm import queries, tokens
from tests.conftest import SF01

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(whole, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 60)  # the cache starts anew again and again
    rnd = random.Random(1)
    parts = [" ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\xa0", "　", " ", "\x85", "\x1c", "a", "the",
             "it's", "we'LL", "'s", "Zürich", "é", "é", "123", "4567", "!?", "...", "<|endoftext|>", "語", "𝔘", "​",
             "x" * 70, "_", "-", "word,", "Ende.", "ª!", "²;", "end,.", "語:"]
    encoder = tokens.Encoder(PATH)
    for _ in range(800):
        texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(25)))
                 for _ in range(rnd.randrange(1, 6))]
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        at = np.r_[0, np.cumsum(counts)].tolist()
        assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == [[*whole(t), 0] for t in texts]


def test_query_equals_brute_force(spark, whole):
    docs = queries.table(spark, SF01, "documents", "doc_id", "text").collect()
    want, start = [], 0
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = [*whole(r.text or ""), 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op12_token_table(spark, SF01)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("encoding,code", [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout(spark, tmp_path, monkeypatch, encoding, code):
    monkeypatch.setattr(tokens, "GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(tokens, "PAGE_BYTES", 8 << 10)
    docs = queries.table(spark, SF01, "documents", "doc_id", "text")
    tokens.write_tokens(docs, str(tmp_path / "t"), PATH, encoding=encoding)
    files = sorted((tmp_path / "t/ids").glob("*.parquet"))
    last, groups = -1, 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        ids = pq.read_table(f, columns=["id"])["id"].to_pylist()
        assert ids == sorted(ids) and ids[0] >= last
        last, groups = ids[-1], groups + meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i)
                       for i in range(meta.num_columns)}
            assert code in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["id"].encodings
            assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if "list" not in n)
            assert columns["ids.list.element"].has_offset_index
    assert groups > len(files)
    read = tokens.read_tokens(spark, str(tmp_path / "t"))
    plan = read.where("id = 17").select("start", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids#" not in plan and "EqualTo(id,17)" in plan  # metadata alone, pushed to the pages
    assert read.where("id = 17").count() == docs.where("doc_id = 17").count()


def test_odd_rows(spark, make, tmp_path, whole):
    long = "wörd " * 60_000 + "x" * 50_000
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "n"), (None, None), (1, None), (2, ""), (3, " \n  \n "), (4, long),
            (9, "  " + "y z\n " * 300_000)]
    df = make(rows, "doc_id long, text string").select(
        "*", *[F.lit(1).alias(c) for c in "id file offset n_tokens ids start first".split()]).repartition(3)
    tokens.write_tokens(df, str(tmp_path / "t"), PATH)
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted(((r.id, tuple(r.ids)) for r in got), key=key) == sorted(
        ((i, (*whole(t or ""), 0)) for i, t in rows), key=key)
    tokens.write_tokens(make([], "doc_id string, text string"), str(tmp_path / "e"), PATH)
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0
    tokens.write_tokens(make([("k", "a b")], "doc_id string, text string"), str(tmp_path / "s"), PATH)
    assert tokens.checksums(tokens.read_tokens(spark, str(tmp_path / "s"))).first().id == "k"
    with pytest.raises(ValueError):
        tokens.write_tokens(df, str(tmp_path / "x"), PATH, encoding="plain")
