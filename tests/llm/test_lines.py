"""Crowded bands of the fuzzy line operator: linear rows, no lost link, and recall against all pairs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kairos.llm import lines, queries
from tests.conftest import SF001


def _jaccard(a, b):
    a, b = lines.shingles(a), lines.shingles(b)
    return len(a & b) / len(a | b)


def _looks(n, seed):
    """Look-alikes of one line, each with one word of its own."""
    rnd = random.Random(seed)
    words = [f"word{i:02d}" for i in range(24)]
    return [" ".join(words[:(at := rnd.randrange(24))] + [f"x{i:05d}"] + words[at + 1:]).encode() for i in range(n)]


def test_comparison_of_a_group_is_exact():
    rnd = random.Random(1)
    for s in range(30):
        group = rnd.sample(_looks(60, s), rnd.randrange(2, 24)) + [b"short", b"", b"short"][:rnd.randrange(4)]
        near = lines._near(group)
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                assert near[i, j] == (_jaccard(group[i], group[j]) >= 0.8 - 1e-9)


def test_look_alikes_make_linear_rows():
    """4,096 look-alikes in one band: under 10,000 link rows of the first round, one label nearly everywhere."""
    texts = _looks(4096, 5)
    rows, cut = [], 32
    for t in texts:
        k = lines.key_of(t)
        own = k % cut
        for block in (range(1, cut) if own == 0 else [own]):
            rows.append((1, block, cut, own == 0, k, zlib.compress(t)))
    rows.sort(key=lambda r: r[1])
    assert len(rows) < 3 * len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["band", "block", "cut", "rep", "key", "line"])
    out = [r for b in lines._first_round([batch]) for r in b.to_pylist()]
    links = [r for r in out if r["band"] is None]
    labels = {r["u"]: r["v"] for r in out if r["band"] is not None}
    assert len(links) < 10_000 and len(labels) == 4096
    assert max(np.unique(list(labels.values()), return_counts=True)[1]) > 4000


def test_parts_that_no_representative_joins_are_linked(spark, monkeypatch):
    """Chains through a crowded band: components are those of all pairs."""
    monkeypatch.setattr(lines, "BLOCK", 8)
    rnd = random.Random(3)
    words = [f"alpha{i:02d}" for i in range(40)]
    chain = [list(words)]
    for i in range(60):                                 # each two words from the one before, far from the first
        w = list(chain[-1])
        for at in rnd.sample(range(40), 1):
            w[at] = f"beta{i:03d}"
        chain.append(w)
    texts = [" ".join(w) for w in chain] + [x.decode() for x in _looks(100, 9)]
    got = lines.similar_lines(spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "t binary").repartition(3))
    comp = {r.node: r.component for r in got.collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for j in range(i):
            if _jaccard(a.encode(), texts[j].encode()) >= 0.8:
                parent[find(i)] = find(j)
    want: dict = {}
    for i, t in enumerate(texts):
        want.setdefault(find(i), set()).add(lines.key_of(t.encode()))
    have: dict = {}
    for k, c in comp.items():
        have.setdefault(c, set()).add(k)
    assert sorted(map(sorted, have.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_recall_of_the_bands(spark):
    """At least 0.99 of the pairs at 0.8 or more share a band."""
    texts = {lines.normal(x) for r in queries.table(spark, SF001, "documents", "text").collect()
             for x in (r.text or "").encode().split(b"\n")} - {b""}
    texts = sorted(texts | set(_looks(150, 11)))
    keys = np.arange(len(texts))
    band, owner = lines._band_entries(texts, keys)
    by: dict = {}
    for b, o in zip(band.tolist(), owner.tolist()):
        by.setdefault(b, set()).add(o)
    met = {(i, j) for group in by.values() for i in group for j in group if i < j}
    sets = [lines.shingles(t) for t in texts]
    post: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    shared: dict = {}
    for group in post.values():
        for x, i in enumerate(group):
            for j in group[x + 1:]:
                shared[i, j] = shared.get((i, j), 0) + 1
    near = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    assert len(near) > 1000 and len(near & met) >= 0.99 * len(near)


def test_lines_too_unlike_in_size_never_meet():
    """A line and half as much again share bands, but not 0.8 of their shingles; entries take 14 bytes."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    short = [" ".join(word() for _ in range(24)) for _ in range(40)]
    texts = [x for s in short for x in (s, s + " " + " ".join(word() for _ in range(12)))]
    looks = [x.decode() for x in _looks(40, 13)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts + looks])], names=["t"])
    blobs = list(lines._signatures(1)([batch]))
    entries = len(lines._band_entries([t.encode() for t in texts + looks], np.arange(len(texts) + 40))[0])
    assert sum(len(x) for b in blobs for c in b.columns[1:] for x in c.to_pylist()) <= 14 * entries
    met = [r for b in lines._meet(blobs) for r in b.to_pylist()]
    groups: dict = {}
    for r in met:
        groups.setdefault(r["band"], set()).add(r["key"])
    key = lambda t: lines.key_of(t.encode())
    assert not any({key(a), key(b)} <= g for a, b in zip(texts[::2], texts[1::2]) for g in groups.values())
    assert {key(t) for t in looks} <= {r["key"] for r in met}


def test_small_groups_are_compared_together(monkeypatch):
    """400 groups of 2 to 16 lines: exact links, by few passes over the shingles."""
    rnd = random.Random(17)
    odd = [b"a", "é日本".encode(), b"abcdef", b"\xff\xfe bad \xe2\x82", b"x" * 5000, b"abc" * 900]
    groups = []
    for s in range(400):
        g = rnd.sample(_looks(20, s), rnd.randrange(2, 15)) + rnd.sample(odd, rnd.randrange(3))
        groups.append(sorted({lines.key_of(t): t for t in g}.items()))
    rows = [(n, 0, 1, True, k, zlib.compress(t)) for n, g in enumerate(groups) for k, t in g]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["band", "block", "cut", "rep", "key", "line"])
    calls, hashes = [], lines._hashes
    monkeypatch.setattr(lines, "_hashes", lambda x: calls.append(len(x)) or hashes(x))
    links = [(r["u"], r["v"]) for b in lines._first_round([batch]) for r in b.to_pylist()]
    assert len(calls) < 40
    text = {k: t for g in groups for k, t in g}
    assert all(_jaccard(text[u], text[v]) >= 0.8 - 1e-9 for u, v in links)

    def parts(nodes, pairs):
        root = {k: k for k in nodes}
        for u, v in pairs:
            a, b = root[u], root[v]
            root = {k: a if r == b else r for k, r in root.items()}
        return {frozenset(k for k in nodes if root[k] == r) for r in root.values()}

    told: dict = {}
    for u, v in links:
        told.setdefault(frozenset((u, v)), (u, v))
    for g in groups[:60]:
        keys = [k for k, _ in g]
        want = [(u, v) for u, a in g for v, b in g if u < v and _jaccard(a, b) >= 0.8 - 1e-9]
        have = [p for p in told.values() if set(p) <= set(keys)]
        assert parts(keys, have) == parts(keys, want)
