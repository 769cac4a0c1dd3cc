"""Near-duplicate lines by MinHash, one line of each component kept.

Lines are compared by their sets of character shingles.  A line's signature is
MinHash over bins of one hash (one permutation, empty bins borrow from filled
ones); lines with few shingles get a signature of separate permutations, and lines
in between get both, so that similar lines always share a kind.  Signatures are cut
into bands.  All lines that meet in a band are compared exactly, inside tasks, in
bounded groups whose intersections are one matrix product; only a spanning forest of
a group's links leaves the task.  A large band is compared in two rounds.  First each of
its blocks meets the first block, whose lines are representatives; a line gets the label of
those that it is linked to.  Then the lines without the band's commonest label meet all
others, and pairs of one label are passed over, as they are linked already.  So a band
of n look-alikes makes about 2 n rows and links, no pair is ever a row, and no link between
two parts of a band is lost.  Bands that hold the same lines are compared once; copies of
one line are one node from the start.  A band is split where the numbers of shingles of its lines
leave a gap that no pair at the limit can span, so fewer lines that can't resemble travel as texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.llm.common import blob_rows, configure, connected_components, materialize, mix, partitions_for

SHINGLE = 6
JACCARD = 0.8
BANDS, ROWS = 12, 4
BINS = BANDS * ROWS
#: Signatures of bins from this many filled bins on, of permutations below that many.
DENSE, SPARSE = 36, 44
#: Band entries per task (16 bytes each), and keys that may be broadcast to fetch candidate lines (8 bytes each).
PER_TASK, BROADCAST_KEYS = 2_000_000, 4_000_000
#: Lines per block; a group is two blocks at most.  Shingle columns per matrix product.
BLOCK, COLUMNS = 128, 4096
#: Groups of up to 16 lines are compared many at a time; characters and lines per sort (it stays in cache).
SMALL, CHUNK, CHUNK_LINES = 16, 60_000, 1000
NONE = np.uint32(0xFFFFFFFF)

_RNG = np.random.default_rng(20240101)
_A = (_RNG.integers(1, 2 ** 32, BINS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2 ** 32, BINS, np.uint64).astype(np.uint32)
_BORROW = _RNG.integers(0, BINS, (256, BINS))
_POWERS = [np.uint64(pow(0x100000001B3, i, 2 ** 64)) for i in range(SHINGLE)]
_FOLD = bytes(32 if i in b"\t\v\f\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))


def normal(line: bytes) -> bytes:
    """A-Z lower-cased, runs of white space as one space, trimmed."""
    return b" ".join(line.lower().split())


def _normal_lines(text: bytes | None) -> list[bytes]:
    """``normal`` of each line of a text."""
    folded = (text or b"").translate(_FOLD)
    if b"  " in folded:
        return [b" ".join(x.split()) for x in folded.split(b"\n")]
    return [x.strip() for x in folded.split(b"\n")]


def key_of(line: bytes) -> int:
    """64-bit identity of a normal line, signed."""
    h = xxhash.xxh3_64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _keys_of(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines)).view(np.int64)


def shingles(line: bytes) -> set[str]:
    s = line.decode("utf-8", "replace")
    return {s[i:i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}


def _bands(sig: np.ndarray, kind: int) -> np.ndarray:
    """Band hashes (lines x BANDS) of signatures (lines x BINS)."""
    s = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    h = np.full(s.shape[:2], kind, np.uint64) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h) + s[:, :, r]
    return mix(h)


def _hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of the lines, and the line of each, in line order."""
    padded = [x if len(x) >= 4 * SHINGLE else x + bytes(max(0, SHINGLE - len(x.decode("utf-8", "replace"))))
              for x in lines]
    cat = np.frombuffer(b"\n".join([*padded, b""]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    end = np.flatnonzero(cat == 10)
    c = cat.astype(np.uint64)
    two = c[:-1] * _POWERS[1] + c[1:]
    h = two[:-4] * _POWERS[4] + two[2:-2] * _POWERS[2] + two[4:]
    inside = np.ones(len(cat), bool)
    for i in range(SHINGLE):
        inside[end - i] = False
    return mix(h[inside[:len(h)]]), np.repeat(np.arange(len(lines)), np.diff(end, prepend=-1) - SHINGLE)


def _band_entries(lines: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hash, key) entries of a list of distinct normal lines."""
    band, at, _ = _sized_entries(lines)
    return band, keys[at]


def _sized_entries(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band hash, number of the line) entries of distinct normal lines, and the shingles of each line."""
    if not lines:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    sigs, sizes, few, owners, first, held = [], [], [], [], 0, 0
    for i, x in enumerate(lines):
        held += len(x)
        if held > CHUNK or i + 1 - first == CHUNK_LINES or i + 1 == len(lines):
            sig, size, h, owner = _minima(lines[first:i + 1])
            sigs.append(sig)
            sizes.append(size)
            few.append(h)
            owners.append(owner + first)
            first, held = i + 1, 0
    sig = np.concatenate(sigs)
    empty = sig == NONE
    filled = BINS - empty.sum(1)
    dense, out_b, out_at = np.flatnonzero(filled >= DENSE), [], []
    if len(dense):
        s, e = sig[dense], empty[dense]
        for borrow in _BORROW:
            if not e.any():
                break
            take = e & ~empty[dense][:, borrow]
            s = np.where(take, s[:, borrow], s)
            e = e & ~take
        out_b.append(_bands(s, 1).ravel())
        out_at.append(np.repeat(dense, BANDS))
    h, owner = np.concatenate(few), np.concatenate(owners)
    start = np.flatnonzero(np.r_[len(h) > 0, owner[1:] != owner[:-1]])
    for k in range(0, len(start), CHUNK_LINES):
        own = start[k:k + CHUNK_LINES]
        x = h[own[0]:start[k + CHUNK_LINES] if k + CHUNK_LINES < len(start) else len(h)]
        s = np.stack([np.minimum.reduceat(x * a + b, own - own[0]) for a, b in zip(_A, _B)], 1)
        out_b.append(_bands(s, 2).ravel())
        out_at.append(np.repeat(owner[own], BANDS))
    return np.concatenate(out_b), np.concatenate(out_at), np.concatenate(sizes)


def _minima(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of at most CHUNK_LINES lines the least value of each bin (lines x BINS) and the shingles; of those with few
    filled bins all hashes and the line of each."""
    n = len(lines)
    h, owner = _hashes(lines)
    high = (h >> np.uint64(32)).astype(np.uint32)
    value = high // np.uint32(BINS)
    # line (10 bits), bin (6), value (27), other bits of the hash (21): the first of a bin is its minimum
    code = (owner << 6).astype(np.uint64) | (high - value * np.uint32(BINS))
    code <<= np.uint64(27)
    code |= value
    code <<= np.uint64(21)
    h &= np.uint64((1 << 21) - 1)
    code |= h
    code.sort()
    new = np.flatnonzero(code[1:] != code[:-1]) + 1
    ends = np.searchsorted(code[new], np.arange(1, n, dtype=np.uint64) << np.uint64(54))
    size = np.diff(np.r_[-1, ends, len(new)])
    cell = (code >> np.uint64(48)).astype(np.int64)
    lead = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    lead = np.r_[0, lead]
    sig = np.full(n * 64, NONE, np.uint32)
    sig[cell[lead]] = (code[lead] >> np.uint64(21)) & np.uint64((1 << 27) - 1)
    sig = sig.reshape(n, 64)[:, :BINS]
    few = np.flatnonzero((sig != NONE).sum(1) < SPARSE)
    at = np.searchsorted(owner, [few, few + 1])
    pick = np.concatenate([np.arange(a, b) for a, b in at.T.tolist()]) if len(few) else few
    return sig, size, high[pick], owner[pick]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_normal_lines(t) for t in b.column(1).to_pylist()]
        lines = [x for t in texts for x in t]
        keys = pa.array(_keys_of(lines), mask=np.fromiter((not x for x in lines), bool, len(lines)))
        ends = np.cumsum([0, *map(len, texts)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, keys)], names=["id", "keys"])


def _distinct_lines(b: pa.RecordBatch, column: int) -> dict[int, bytes]:
    lines = [x for t in b.column(column).to_pylist() for x in _normal_lines(t) if x]
    return dict(zip(_keys_of(lines).tolist(), lines))


def _signatures(buckets: int):
    """Entries by bucket: 32 bits of the band, shingles of the line (65,535 at most), key of the line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = _distinct_lines(b, 0)
            if not lines:
                continue
            band, at, size = _sized_entries(list(lines.values()))
            owner, size = np.fromiter(lines, np.int64, len(lines))[at], np.minimum(size, 65535).astype(np.uint16)[at]
            rows = list(blob_rows(((band >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64),
                                  [band.astype(np.uint32), size, owner], buckets))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[1][j] for r in rows], pa.binary())
                                                             for j in range(3)]],
                names=["bucket", "band", "size", "owner"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, n): the n lines that share a band and may resemble, two or more; band is the hash of their keys."""
    parts: list[list[np.ndarray]] = [[], [], []]
    for b in batches:
        for out, column, kind in zip(parts, b.columns[1:], (np.uint32, np.uint16, np.int64)):
            out += [np.frombuffer(x, kind) for x in column.to_pylist()]
    if not parts[0]:
        return
    band, size, owner = map(np.concatenate, parts)
    del parts
    order = np.argsort(band)
    same = band[order]
    same = same[1:] == same[:-1]
    order = order[np.r_[same, False] | np.r_[False, same]]
    band, size, owner = band[order], size[order], owner[order]
    order = np.lexsort((owner, size, band))
    band, size, owner = band[order], size[order].astype(np.float64), owner[order]
    if len(band):
        new = np.r_[True, (band[1:] != band[:-1]) | (owner[1:] != owner[:-1])]
        band, size, owner = band[new], size[new], owner[new]
        # in order of size, no pair across such a gap is similar (one shingle less for a clash of hashes)
        start = np.r_[True, (band[1:] != band[:-1]) | (size[:-1] + 1 < JACCARD * size[1:])]
        n = np.diff(np.append(np.flatnonzero(start), len(band)))
        many = np.repeat(n > 1, n)          # copies of one line are no company
        start, owner, n = start[many], owner[many], n[n > 1]
    if len(owner):
        band = mix(np.add.reduceat(mix(owner.view(np.uint64)), np.flatnonzero(start)) + n.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(band.view(np.int64), n)), pa.array(owner),
                                          pa.array(np.repeat(n, n))], names=["band", "key", "n"])


def _fetch(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """(key, line): the normal line, deflated, of each of the n keys in ``keys`` (distinct column key)."""
    spark = docs.sparkSession
    sent = None
    if n <= BROADCAST_KEYS:
        wanted = np.sort(np.array([r[0] for r in keys.collect()], np.int64)) if n < 1000 else \
            np.sort(keys.toPandas()["key"].to_numpy(np.int64))
        sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = _distinct_lines(b, 0)
            if sent is not None and lines:
                k = np.fromiter(lines, np.int64, len(lines))
                want = sent.value
                at = np.minimum(np.searchsorted(want, k), max(0, len(want) - 1))
                hit = want[at] == k if len(want) else np.zeros(len(k), bool)
                lines = {x: lines[x] for x in k[hit].tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int64()),
                                              pa.array([zlib.compress(x, 1) for x in lines.values()], pa.binary())],
                                             names=["key", "line"])

    found = docs.mapInArrow(run, "key long, line binary")
    if sent is None:
        found = found.join(keys, "key", "left_semi")
    return found.groupBy("key").agg(F.min("line").alias("line"))


def _near(lines: list[bytes]) -> np.ndarray:
    """Which pairs of lines (i < j) are similar."""
    n = len(lines)
    h, owner = _hashes(lines)
    order = np.argsort(h, kind="stable")                # owners stay in order within a shingle
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    h, owner = h[new], owner[new]
    size = np.bincount(owner, minlength=n)
    fresh = np.r_[True, h[1:] != h[:-1]]
    alone = fresh & np.r_[fresh[1:], True]              # shingles of one line don't meet
    h, owner = h[~alone], owner[~alone]
    both = np.zeros((n, n), np.float32)
    col = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.empty(0, np.int64)
    top = int(col[-1]) + 1 if len(col) else 0
    for first in range(0, top, COLUMNS):
        a, b = np.searchsorted(col, [first, first + COLUMNS])
        m = np.zeros((n, min(COLUMNS, top - first)), np.float32)
        m[owner[a:b], col[a:b] - first] = 1.0
        both += m @ m.T
    near = both >= JACCARD * (size[:, None] + size[None, :] - both) - 1e-6
    return near & np.triu(np.ones((n, n), bool), 1)


def _near_pairs(groups: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """Pairs of similar lines (i < j) of each of many groups of at most SMALL lines."""
    out: list[list[tuple[int, int]]] = []
    part: list[list[bytes]] = []
    held = 0
    for k, g in enumerate(groups):
        part.append(g)
        held += sum(map(len, g))
        if held > CHUNK or len(part) == 256 or k + 1 == len(groups):
            out += _near_part(part)
            part, held = [], 0
    return out


def _near_part(groups: list[list[bytes]]) -> list[list[tuple[int, int]]]:
    """``_near_pairs`` of at most 256 groups: one sort by group, shingle and line."""
    n = len(groups)
    h, owner = _hashes([x for g in groups for x in g])
    place = np.array([k * SMALL + i for k, g in enumerate(groups) for i in range(len(g))])[owner].astype(np.uint64)
    bits, low = max(1, (n - 1).bit_length()), SMALL.bit_length() - 1
    code = np.sort((place >> np.uint64(low)) << np.uint64(64 - bits) | h >> np.uint64(bits + low) << np.uint64(low)
                   | place & np.uint64(SMALL - 1))
    code = code[np.r_[True, code[1:] != code[:-1]]]
    group, line = (code >> np.uint64(64 - bits)).astype(np.int64), (code & np.uint64(SMALL - 1)).astype(np.int64)
    size = np.bincount(group * SMALL + line, minlength=n * SMALL).reshape(n, SMALL)
    shingle = code >> np.uint64(low)
    both = np.zeros(n * SMALL * SMALL, np.int64)
    at = np.arange(len(code))
    for d in range(1, SMALL):                           # lines that hold a shingle follow one another
        at = at[:np.searchsorted(at, len(code) - d)]
        at = at[shingle[at] == shingle[at + d]]
        if not len(at):
            break
        both += np.bincount((group[at] * SMALL + line[at]) * SMALL + line[at + d], minlength=len(both))
    both = both.reshape(n, SMALL, SMALL)
    near = (both > 0) & (both >= JACCARD * (size[:, :, None] + size[:, None, :] - both) - 1e-6)
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    for k, i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        out[k].append((i, j))
    return out


def _forest(pairs: Iterable[tuple[int, int]], start: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """(spanning forest of ``pairs``, root of each line), where lines i and start[i] are linked already."""
    parent = list(start)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs:
        r, q = find(i), find(j)
        if r != q:
            parent[max(r, q)] = min(r, q)       # the first line of a part is its root
            out.append((i, j))
    return out, [find(i) for i in range(len(parent))]


def _pairs(near: np.ndarray) -> Iterable[tuple[int, int]]:
    return zip(*(x.tolist() for x in np.nonzero(near)))


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple] | None]:
    """Rows of each group, which follow one another and share their first ``columns`` values; None after a batch."""
    group, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:columns] != group:
                if rows:
                    yield rows
                group, rows = row[:columns], []
            rows.append(row)
        yield None
    if rows:
        yield rows
    yield None


_TOLD = pa.schema([("band", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("line", pa.binary())])


def _told(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind.type) for k, kind in enumerate(_TOLD)],
                                      schema=_TOLD)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups (band, block) with rows (band, block, cut, rep, key, line): links (null, u, v, null), and for bands
    of several blocks the label v of each line u, with its text."""
    out: list[tuple] = []
    small: list[list[tuple]] = []

    def tell(rows: list[tuple], pairs: Iterable[tuple[int, int]]) -> None:
        keys = [r[4] for r in rows]
        links, root = _forest(pairs, list(range(len(rows))))
        out.extend((None, keys[i], keys[j], None) for i, j in links)
        band, block, cut = rows[0][:3]
        if cut > 1:
            out.extend((band, k, keys[root[i]], rows[i][5]) for i, k in enumerate(keys) if not rows[i][3] or block == 1)

    for rows in _groups(batches, 2):
        if rows is None:
            for g, pairs in zip(small, _near_pairs([[zlib.decompress(r[5]) for r in g] for g in small])):
                tell(g, pairs)
            yield _told(out)
            out.clear()
            small.clear()
            continue
        rows.sort(key=lambda r: (not r[3], r[4]))       # representatives first, by key: they give the labels
        if len(rows) <= SMALL:
            small.append(rows)
        else:
            tell(rows, _pairs(_near([zlib.decompress(r[5]) for r in rows])))


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between parts of different labels, of groups (band, i, j) with rows (band, i, j, rest, key, label, line)."""
    out: list[tuple] = []
    for rows in _groups(batches, 3):
        if rows is None:
            yield _told(out)
            out = []
            continue
        seen: dict[int, int] = {}
        rows = list({(r[3], r[4]): r for r in rows}.values())
        label = [seen.setdefault(r[5], i) for i, r in enumerate(rows)]
        side = np.array([r[3] for r in rows], bool)
        if len(seen) < 2 or side.all() or not side.any():
            continue
        near = _near([zlib.decompress(r[6]) for r in rows])
        near &= (side[:, None] != side[None, :]) & (np.array(label)[:, None] != np.array(label)[None, :])
        out += [(None, rows[i][4], rows[j][4], None) for i, j in _forest(_pairs(near), label)[0]]


def similar_lines(docs: DataFrame) -> DataFrame:
    """(node, component) of distinct normal lines of ``docs`` (one binary column) that resemble another."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs.columns[0]))).first()[0] or 0
    buckets = partitions_for(spark, size / 250 * BANDS, PER_TASK)
    met = materialize(docs.mapInArrow(_signatures(buckets), "bucket int, band binary, size binary, owner binary")
                      .repartition(buckets, "bucket").mapInArrow(_meet, "band long, key long, n long"))
    keys = met.select("key").distinct()
    n_keys = keys.count()
    # bands of the same lines have one number
    member = met.distinct()
    cut = F.ceil(F.col("n") / BLOCK).cast("int")
    member = member.select("band", "key", cut.alias("cut"), F.pmod(F.xxhash64("key"), cut).cast("int").alias("own"))
    member = _fetch(docs, keys, n_keys).join(member, "key")
    # a band of one block is a group; of more, each block but the first meets the first
    blocks = F.when((F.col("own") == 0) & (F.col("cut") > 1), F.expr("sequence(1, cut - 1)")).otherwise(F.array("own"))
    rows = member.select("band", F.explode(blocks).alias("block"), "cut", (F.col("own") == 0).alias("rep"), "key", "line")
    tasks = partitions_for(spark, n_keys, 5_000)
    first = materialize(rows.repartition(tasks, "band", "block").sortWithinPartitions("band", "block")
                        .mapInArrow(_first_round, "band long, u long, v long, line binary"))
    labels = first.where("band IS NOT NULL").select("band", F.col("u").alias("key"), F.col("v").alias("label"), "line")
    share = labels.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    left = (share.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n"))
            .select("band", F.col("m.label").alias("common"), "n", (F.col("n") - F.col("m.c")).alias("rest"))
            .where("rest > 0"))
    part = materialize(labels.join(left, "band"))
    mine = lambda of: F.pmod(F.xxhash64("key", F.lit(7)), F.ceil(F.col(of) / BLOCK)).cast("int")
    every = lambda of: F.explode(F.expr(f"sequence(0, CAST(ceil({of} / {BLOCK}) AS INT) - 1)"))
    rest = part.where("label <> common").select("band", mine("rest").alias("i"), every("n").alias("j"),
                                                F.lit(True).alias("rest"), "key", "label", "line")
    whole = part.select("band", every("rest").alias("i"), mine("n").alias("j"), F.lit(False).alias("rest"), "key", "label",
                        "line")
    second = (rest.unionByName(whole).repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j")
              .mapInArrow(_second_round, "band long, u long, v long, line binary"))
    links = first.where("band IS NULL").select("u", "v").unionByName(second.select("u", "v"))
    return materialize(connected_components(links))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line_no (from 0), keep_id, keep_line, kept.

    (keep_id, keep_line) is the first line, by id and number, of the line's
    component; kept tells whether the row is that line.  Lines without a word are kept and
    stand alone (their own id and number).  Null and empty texts have one empty line;
    null ids come last; of repeated rows with one id, each keeps its copy of the line.
    """
    configure(docs.sparkSession)
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    kind = lean.schema["id"].dataType.simpleString()
    marks = materialize(lean.mapInArrow(_marks, f"id {kind}, keys array<long>"))
    each = marks.select("id", F.posexplode("keys").alias("line_no", "key"))
    comp = similar_lines(lean.select("t")).select(F.col("node").alias("key"), "component")
    order = F.struct(F.col("id").isNull().alias("n"), "id", "line_no")
    first = each.where("key is not null").groupBy("key").agg(F.min(order).alias("f"))
    first = materialize(first.join(comp, "key", "left").withColumn("c", F.coalesce("component", "key")))
    best = first.where("component is not null").groupBy("c").agg(F.min("f").alias("g"))
    named = first.join(best, "c", "left").select("key", F.coalesce("g", "f").alias("g"))
    told = each.where("key is not null").join(named, "key").select(
        "id", "line_no", F.col("g.id").alias("keep_id"), F.col("g.line_no").alias("keep_line"))
    blank = each.where("key is null").select("id", "line_no", F.col("id").alias("keep_id"),
                                             F.col("line_no").alias("keep_line"))
    return told.unionByName(blank).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("line_no") == F.col("keep_line")))
