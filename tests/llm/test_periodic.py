"""Periodic runs against brute force: random periodic texts, whole tables, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairos.llm import periodic, queries
from tests.conftest import SF001
from tests.llm import brute


def _random_words(rnd, longest):
    w = []
    while len(w) < rnd.choice([5, 30, 100, longest]):
        p = rnd.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100])
        unit = [rnd.randrange(rnd.choice([1, 2, 2, 3, 1000])) for _ in range(p)]
        w += [unit[i % p] for i in range(int(p * rnd.uniform(0.5, 6)))]
    return w


@pytest.mark.parametrize("tile", [1, 40, 1024])
def test_tiles_and_boundaries_lose_no_run(tile, monkeypatch):
    """Runs of the tiles' fragments, stitched, are all runs, wherever tiles are cut."""
    monkeypatch.setattr(periodic, "TILE", tile)
    rnd = random.Random(tile)
    for _ in range(400):
        w = _random_words(rnd, 600)
        stretches = {}
        for k, first, count, ids in periodic.tiles(np.array(w, np.int32)):
            for q, s, e in periodic.solve(k, first, count, ids.tolist()):
                stretches.setdefault(q, []).append((s, e))
        found = {}
        for q in sorted(stretches):
            merged = []
            for s, e in sorted(stretches[q]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            for s, e in merged:
                if e - s + q >= max(24, 3 * q):
                    found.setdefault((s, e - s + q), q)
        assert sorted((s, n, q) for (s, n), q in found.items()) == sorted(brute.periodic_runs(w))


def test_z_function():
    rnd = random.Random(3)
    for _ in range(200):
        s = [rnd.randrange(2) for _ in range(rnd.randrange(40))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic.z_function(s) == want[:len(s)]


def test_query_equals_brute_force(spark):
    docs = queries.table(spark, SF001, "documents", "doc_id", "text").collect()
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SF001).collect()}
    assert got == {brute.periodic_row(r.doc_id, r.text) for r in docs} and len(docs) == len(got)
    assert sum(r[1] > 0 for r in got) > 10


def test_chosen_texts_without_words(spark, make):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4] + [None]
    texts = [None, "", " \n ", "a b", "c d"]
    got = queries.with_repeats(make(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, tuple((r.text or "").split())) for r in got} == {
        (i, tuple(brute.planted(i, t))) for i, t in zip(ids, texts)}


def test_odd_rows(spark, make):
    """Null, empty, blank, very long, one-word and repeated texts, null and repeated ids, clashing columns."""
    rnd = random.Random(5)
    long = [str(rnd.randrange(9)) for _ in range(30_000)]
    long[9_000:19_000] = [str(i % 3_333) for i in range(10_000)]
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "one"), (5, "x " * 23), (6, "x " * 24), (6, "x " * 24),
            (None, "a b c\n" * 30), (None, "a b c\n" * 30), (7, " ".join(long)), (8, "tie tie TIE " * 9),
            (9, "é é x " * 40), (10, "y " * 3000 + "z " * 3000)]
    df = make(rows, "doc_id long, text string").select(
        "*", *[F.lit(1).alias(c) for c in "key id n words sha octave first tile runs s e period".split()])
    got = periodic.find_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {t for i, t in rows if i == r.id}
        w = brute.WORD.findall(next(iter(texts)) or "")
        want = brute.periodic_runs(w) if len(w) < 29_000 else [(9_000, 10_000, 3_333)]
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(w)
        assert (set(want) <= set(runs)) if len(w) > 29_000 else runs == want
        assert (r.collapsed is None) == (not runs)
        if r.collapsed is not None:
            drop = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert periodic.find_runs(make([], "doc_id long, text string")).count() == 0
    named = periodic.find_runs(make([("a", "x " * 30)], "doc_id string, text string")).first()
    assert (named.id, named.collapsed) == ("a", "x")
