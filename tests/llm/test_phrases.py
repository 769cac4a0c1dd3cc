"""Collocations against brute force; summaries against exact counts."""

import collections
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairos.llm import phrases, queries
from tests.conftest import SF001, SF01
from tests.llm import brute


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in queries.table(spark, sf, "documents", "lang", "text").collect()]
    got = queries.op13_collocations(spark, sf)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(brute.collocations(docs)) and len(rows) > 10


@pytest.mark.parametrize("shape", ["even", "hot", "rare"])
def test_summary_keeps_every_frequent_key(shape):
    rnd = random.Random(shape)
    for _ in range(30):
        keys = [min(int(rnd.paretovariate(0.6)), 5000) if shape == "even" else
                (0 if rnd.random() < 0.5 else rnd.randrange(4000)) if shape == "hot" else rnd.randrange(40_000)
                for _ in range(20_000)]
        exact = collections.Counter(keys)
        summary = phrases.MisraGries(len(keys), 30)
        for s in range(0, len(keys), 700):
            k, c = phrases._counted(np.array(keys[s:s + 700], np.int64))
            summary.add(k, c)
            summary.merge()  # as often as can be, so that much is taken off
            assert len(summary.keys) <= summary.capacity
        left = set(summary.survivors().tolist())
        assert {k for k, n in exact.items() if n >= 30} <= left and summary.off < 30
        for k, n in zip(summary.keys.tolist(), summary.counts.tolist()):
            assert n <= exact[k] <= n + summary.off


def test_cuts_of_long_texts_change_no_count(monkeypatch):
    """Words counted in many short series, with a filter that lets all through: exact counts."""
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["\xc9", "a.b", "\xe9t\xe9,"]
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(200)))) for _ in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    every = types.SimpleNamespace(value=b"\xff" * 64)

    def counts():
        total = collections.Counter()
        for out in phrases._count(4, 64, every)([batch]):
            for r in out.to_pylist():
                total[r["lang"], r["n"], r["phrase"]] += r["c"]
        return total

    whole = counts()
    monkeypatch.setattr(phrases, "WORDS", 57)
    assert counts() == whole and len(whole) > 10_000
    monkeypatch.setattr(phrases, "GROUP", 300)
    assert counts() == whole
    monkeypatch.setattr(phrases, "FLUSH", 500)
    mass = sum(r["mass"] for out in phrases._summarise(7)([batch]) for r in out.to_pylist() if not r["seq"])
    assert mass == sum(c for k, c in whole.items() if k[1])


def test_crowded_filter_changes_nothing(spark, make, monkeypatch):
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "de", None, "und"]), " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(200))))
            for _ in range(120)]
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    df = make(rows, "lang string, text string").repartition(3)
    want = sorted(brute.collocations(rows, least=5))
    assert sorted(map(tuple, phrases.collocations(df, least=5).collect())) == want and want


def test_odd_rows(spark, make):
    """Null and blank texts and languages, marks alone, ties, repeated rows, long texts, clashing columns."""
    rows = ([("en", None), ("en", ""), (None, " .,;\n"), ("en", "AB cd\tEF. ab CD ef")] + [("en", "tie one, tie two!")] * 30
            + [(None, "x y z w v")] * 15 + [("und", "X Y Z W V")] * 15 + [("de", "Äh äh A a " * 4000)]
            + [("fr", "\xa0 été\x0bà la\rcarte " * 31)])
    df = make(rows, "lang string, text string").select(
        "*", *[F.lit(1).alias(c) for c in "n f phrase a l r k w c part seq mass score rank _p".split()]).repartition(4)
    got = sorted(map(tuple, phrases.collocations(df).collect()))
    assert got == sorted(brute.collocations(rows)) and {r[0] for r in got} == {"en", "und", "de", "fr"}
    few = sorted(map(tuple, phrases.collocations(df, top=2).collect()))
    assert few == sorted(brute.collocations(rows, top=2))
    assert phrases.collocations(make([], "lang string, text string")).count() == 0


def test_scores_past_64_bits(make):
    big = 6 * 10 ** 17
    rows = [("en", 1, "a", big + 1), ("en", 1, "b", big + 2), ("en", 1, "c", big + 1), ("en", 2, "a b", big),
            ("en", 2, "b c", big), ("en", 3, "a b c", big * 79 // 100)]
    got = {r.phrase: r.score for r in phrases.score(make(rows, "lang string, n int, phrase string, f long")).collect()}
    cut = lambda a, x, y: 2_000_000 * a // (x + y)
    long = big * 79 // 100
    assert got == {"a b": cut(big, big + 1, big + 2), "b c": cut(big, big + 2, big + 1),
                   "a b c": min(cut(long, big + 1, big), cut(long, big, big + 1))}
