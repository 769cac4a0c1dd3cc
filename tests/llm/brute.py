"""Plain-Python versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def fingerprint(text, n=3):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    """{id: (hex fingerprint, component id)}; ids are distinct."""
    fp = {i: fingerprint(t) for i, t in docs}
    comp = components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, f in fp.items():
        first[comp[f]] = min(i, first.get(comp[f], i))
    return {i: (f"{f:016x}", first[comp[f]]) for i, f in fp.items()}


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)."""
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    count = collections.Counter(x[2] for x in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(said.encode()).hexdigest()


def contained(docs, items, n=5, t=0.8):
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            k = min(n, len(v))
            own = {tuple(v[j:j + k]) for j in range(len(v) - k + 1)}
            mine = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if len(own & mine) >= t * len(own) - 1e-9:
                out.append((d, i, len(own & mine), len(own)))
    return sorted(out)


def base_scores(docs):
    """{id: (held_out, n_tokens, n_known, N, base_score)}."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = collections.Counter()
    for i, t in docs:
        if not fold[i]:
            c.update([*words(t), None])
    total, scale = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    return {i: (fold[i], len(words(t)) + 1, sum(k in c for k in [*words(t), None]), total,
                sum(math.log10((c[k] + 0.5) / scale) for k in [*words(t), None])) for i, t in docs}


def line_components(docs, norm, shingles, t=0.8):
    """{(id, line): (id, line) kept}; lines without a word stand alone."""
    where = collections.defaultdict(list)
    out = {}
    for i, text in docs:
        for n, x in enumerate((text or "").encode().split(b"\n")):
            if norm(x):
                where[norm(x)].append((i, n))
            else:
                out[i, n] = (i, n)
    sets = {x: shingles(x) for x in where}
    comp = components(sorted(where), lambda a, b: len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)
    first = {}
    for x, at in where.items():
        first[comp[x]] = min([*at, first.get(comp[x], min(at))])
    for x, at in where.items():
        for a in at:
            out[a] = first[comp[x]]
    return out


def planted(doc_id, text):
    """Words of a text, one in ten of which repeats up to its end."""
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w):
    """[(start, length, smallest period)] of the runs, by start, then period."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_row(doc_id, text):
    w = planted(doc_id, text)
    runs = periodic_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def collocations(docs, least=30, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of (lang, text) rows."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    rows = collections.defaultdict(list)
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], p))
    inside = collections.Counter()
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                key = lang, p[s:s + m]
                inside[key] = max(inside[key], a)
    out = []
    for lang, some in rows.items():
        some = sorted(x for x in some if 100 * inside[lang, x[5]] < 80 * -x[1])
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(some[:top])]
    return out
