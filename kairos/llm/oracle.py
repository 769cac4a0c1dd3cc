"""DuckDB SQL of the queries that SQL can express.

The others (extraction, fingerprints, fuzzy lines, robust covariance, the language
model) are tested against brute force in tests/llm."""

from __future__ import annotations

from kairos.llm import decontaminate, mixing, secrets, sharding

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_arc_to_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5)
          AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER) + 1, 1)), '') AS payload_digest FROM d),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS last FROM b GROUP BY 1, 2)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
       CASE WHEN b.page_id = m.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id = m.last THEN NULL ELSE m.last END AS refers_to
FROM b JOIN m ON b.payload_digest = m.payload_digest AND b.payload_bytes = m.payload_bytes"""

_GRAMS = ("list_transform(range(CAST(greatest(1, len(w) - {n} + 1) AS BIGINT)), "
          "lambda i: array_to_string(list_slice(w, CAST(i + 1 AS BIGINT), CAST(i + {n} AS BIGINT)), ' '))")
SQL["op3_benchmark_containment"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(n=decontaminate.SHINGLE)}) AS g FROM d WHERE len(w) >= {decontaminate.SHINGLE}),
ig AS (SELECT DISTINCT item_id, unnest({_GRAMS.format(n=decontaminate.SHINGLE)}) AS g FROM i WHERE len(w) >= {decontaminate.SHINGLE}),
q AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1),
s AS (SELECT dg.doc_id, ig.item_id, count(*) AS shared FROM ig JOIN dg ON ig.g = dg.g GROUP BY 1, 2)
SELECT s.doc_id, s.item_id, CAST(s.shared AS BIGINT) AS shared, CAST(q.n AS BIGINT) AS item_shingles,
       CAST(s.shared AS DOUBLE) / q.n AS containment
FROM s JOIN q ON s.item_id = q.item_id WHERE s.shared >= {decontaminate.CONTAINMENT} * q.n - 1e-9"""


def _spans(i: int, r: secrets.Rule) -> str:
    rx = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, e - n AS a, e AS b FROM (
  SELECT doc_id, n, own, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
    SELECT doc_id, unnest(range(len(m))) AS k, unnest(list_transform(m, lambda x: length(x))) AS n,
           unnest(list_transform(list_slice(p, 1, len(m)), lambda x: length(x))) AS gap,
           unnest(list_transform(o, lambda x: length(x))) AS own
    FROM (SELECT doc_id, regexp_extract_all(t, {rx}, 0) AS m, string_split_regex(t, {rx}) AS p,
                 regexp_extract_all(t, {rx}, {r.group}) AS o FROM d) WHERE len(m) > 0)) WHERE own >= {r.least}"""


_SAID = "string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, rank){0}"
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)
SQL["op5_blob_ledger_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(_spans(i, r) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.RULES if r.base)},
             {_SAID.format(f" FILTER (WHERE kind IN ({_BASE}))")} AS base, {_SAID.format('')} AS spans
      FROM s GROUP BY 1)
SELECT d.doc_id, {', '.join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secrets.RULES if r.base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""

_N = sharding.TABLE_SIZE
_HEX = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"
_SLOTS = f"list_transform(range({_N}), lambda j: CAST((o + j * s) % {_N} AS INTEGER) + 1)"
SQL["op7_slot_table_placement"] = f"""
WITH RECURSIVE names AS (SELECT unnest(range({len(sharding.SHARDS)})) AS i,
                                unnest([{', '.join(f"'{s}'" for s in sharding.SHARDS)}]) AS name),
pref AS (SELECT i, {_HEX.format("'offset:' || name")} % {_N} AS o, {_HEX.format("'skip:' || name")} % {_N - 1} + 1 AS s
         FROM names),
walk AS (SELECT i, {_SLOTS} AS path FROM pref),
fill AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS slot, list_transform(range({_N}), lambda j: true) AS open
         UNION ALL
         SELECT k + 1, spot, list_transform(open, lambda x, j: x AND j <> spot)
         FROM (SELECT f.k, f.open, list_filter(w.path, lambda p: f.open[p])[1] AS spot
               FROM fill f JOIN walk w ON w.i = f.k % {len(sharding.SHARDS)} WHERE f.k < {_N})),
t AS (SELECT f.slot - 1 AS slot, n.name AS shard FROM fill f JOIN names n ON n.i = (f.k - 1) % {len(sharding.SHARDS)}
      WHERE f.slot IS NOT NULL),
d AS (SELECT doc_id, {_HEX.format("coalesce(CAST(doc_id AS VARCHAR), 'null')")} % {_N} AS slot FROM documents)
SELECT d.doc_id, CAST(d.slot AS BIGINT) AS slot, t.shard FROM d JOIN t ON d.slot = t.slot"""

_W = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
_BITS = mixing.BITS
SQL["op10_pareto_mix"] = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, {_BITS // 4}) AS BIGINT) AS k
           FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, {_W}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM s0),
s2 AS (SELECT *, {mixing.MAX_COPIES} * source_size AS cap,
              row_number() OVER (ORDER BY {mixing.MAX_COPIES} * source_size / CAST(w AS DOUBLE), source NULLS LAST) AS r FROM s1),
tot AS (SELECT {mixing.SHARE} * sum(source_size) AS total FROM s0),
s3 AS (SELECT s2.*, (total - (sum(cap) OVER (ORDER BY r) - cap)) / (sum(w) OVER () - (sum(w) OVER (ORDER BY r) - w)) AS level
       FROM s2 CROSS JOIN tot),
lv AS (SELECT level FROM s3 WHERE cap >= level * w ORDER BY r LIMIT 1),
p AS (SELECT source, source_size, least(lv.level * w, CAST(cap AS DOUBLE)) AS target FROM s3 CROSS JOIN lv),
p1 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM p),
p2 AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, target - floor(ratio) * source_size AS rest,
              ratio - floor(ratio) AS pi FROM p1),
len AS (SELECT source, size, count(*) AS c FROM d WHERE size > 0 GROUP BY 1, 2),
sq AS (SELECT len.source, len.size, p2.rest - CAST(coalesce(sum(c * size) OVER longer, 0) AS DOUBLE) AS draw,
              CAST(sum(c * size * size) OVER others AS DOUBLE) AS squares
       FROM len JOIN p2 ON len.source IS NOT DISTINCT FROM p2.source WHERE p2.pi > 0
       WINDOW longer AS (PARTITION BY len.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              others AS (PARTITION BY len.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT source, size AS edge, draw, draw / squares AS unit FROM sq WHERE draw / squares * size < 1
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC) = 1),
y AS (SELECT d.doc_id, d.source, d.size, p2.source_size, p2.target, p2.whole, u.edge,
             CASE WHEN d.size > 0 AND d.size <= u.edge THEN u.unit * d.size END AS pi,
             (d.k + CAST(0.5 AS DOUBLE)) / CAST({1 << _BITS} AS DOUBLE) AS v
      FROM d JOIN p2 ON d.source IS NOT DISTINCT FROM p2.source LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source),
z AS (SELECT *, (v / (1 - v)) / (pi / (1 - pi)) AS rank FROM y),
r AS (SELECT *, CAST(floor(rank / (1 + rank) * CAST({1 << _BITS} AS DOUBLE)) AS BIGINT) AS k FROM z),
x AS (SELECT *, sum(size) OVER run AS cum, row_number() OVER run AS n
      FROM r WHERE pi IS NOT NULL
      WINDOW run AS (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT source, 0 AS n, 0 AS k, abs(draw) AS gap FROM u
      UNION ALL SELECT x.source, n, k, abs(cum - draw) FROM x JOIN u ON x.source IS NOT DISTINCT FROM u.source),
c AS (SELECT source, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap, k, n) AS best FROM e) WHERE best = 1),
t AS (SELECT x.doc_id, x.size, x.source_size, x.target, x.whole + CASE WHEN x.n <= c.n THEN 1 ELSE 0 END AS copies
      FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source
      UNION ALL SELECT doc_id, size, source_size, target, whole + CASE WHEN size > edge THEN 1 ELSE 0 END
      FROM r WHERE pi IS NULL)
SELECT *, copies * size AS taken FROM t"""
