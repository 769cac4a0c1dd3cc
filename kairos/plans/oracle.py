"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Doubles are rounded to 6 places with the same IEEE operations as the Spark
side (:func:`kairos.plans.standins.r6`), so results compare bit for bit.
"""

from __future__ import annotations

from kairos.operators.series import _P_LOW, _QA, _QB, _QC, _QD

EV_PANEL = """
obs0 AS (
  SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n_events, avg(value) AS value_mean,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k_mean
  FROM events GROUP BY 1, 2),
obs AS (SELECT *, ts AS obs_ts FROM obs0),
bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM obs),
grid AS (
  SELECT e.event_type, unnest(generate_series(b.lo, b.hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN bounds b),
panel AS (
  SELECT g.event_type, g.ts, o.n_events, o.value_mean, o.k_mean, o.obs_ts
  FROM grid g LEFT JOIN obs o ON g.event_type = o.event_type AND g.ts = o.ts)
"""

EV_CUT = "TIMESTAMP '2024-01-16 00:00:00'"
LI_CUT = "TIMESTAMP '2000-01-01 00:00:00'"

LI_Y = ("l_quantity + ((ascii(l_returnflag) - 65) * 0.25 + CASE WHEN l_linestatus = 'O' THEN 1.5 ELSE 0.0 END)"
        f" - CASE WHEN l_shipdate >= {LI_CUT} THEN 3.0 ELSE 0.0 END")

DOW = "(dayofweek({t}) + 1)"
WEEKEND = "CASE WHEN {t} IS NULL THEN NULL WHEN (dayofweek({t}) + 1) IN (6, 7) THEN 'weekend' ELSE 'weekday' END"
TOD_CAT = ("CAST(CAST(floor(hour({t}) / 2) * 2 AS BIGINT) AS VARCHAR) || '-' || "
           "CAST(CAST(floor(hour({t}) / 2) * 2 + 1 AS BIGINT) AS VARCHAR)")
SEASON = ("CASE WHEN month({t}) IN (12, 1, 2) THEN 'Winter' WHEN month({t}) IN (3, 4, 5) THEN 'Spring' "
          "WHEN month({t}) IN (6, 7, 8) THEN 'Summer' WHEN month({t}) IN (9, 10, 11) THEN 'Fall' END")
COMPASS = "['North', 'North-east', 'East', 'South-east', 'South', 'South-west', 'West', 'North-west']"
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def _r(x: str, d: int = 6) -> str:
    if d != 6:
        return f"round_even({x}, {d})"
    return (f"(CASE WHEN abs({x}) < 1e9 THEN floor(floor(({x}) * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6 "
            f"ELSE ({x}) END)")


def _horner(coefs, x: str) -> str:
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc}) * ({x}) + ({c!r})"
    return acc


def norm_quantile_sql(p: str) -> str:
    central = f"({_horner(_QA, '(' + p + ' - 0.5) * (' + p + ' - 0.5)')}) * ({p} - 0.5) / (({_horner(_QB, '(' + p + ' - 0.5) * (' + p + ' - 0.5)')}) * (({p} - 0.5) * ({p} - 0.5)) + 1.0)"
    ql = f"sqrt(-2.0 * ln({p}))"
    qu = f"sqrt(-2.0 * ln(1.0 - {p}))"
    low = f"({_horner(_QC, ql)}) / (({_horner(_QD, ql)}) * {ql} + 1.0)"
    high = f"-({_horner(_QC, qu)}) / (({_horner(_QD, qu)}) * {qu} + 1.0)"
    return (f"CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {_P_LOW!r} THEN {low} "
            f"WHEN {p} > {1 - _P_LOW!r} THEN {high} ELSE {central} END")


SQL: dict[str, str] = {}

SQL["panel_complete"] = f"""WITH {EV_PANEL}
SELECT event_type, ts, CAST(n_events AS BIGINT) AS n_events, {_r('value_mean')} AS value_mean FROM panel"""

SQL["prepost_summary"] = f"""WITH {EV_PANEL},
f AS (SELECT *, obs_ts >= {EV_CUT} AS intervention FROM panel)
SELECT intervention, 'value_mean' AS variable, {_r('avg(value_mean)', 2)} AS mean,
       {_r('stddev_samp(value_mean)', 2)} AS sd FROM f WHERE intervention IS NOT NULL GROUP BY 1
UNION ALL
SELECT intervention, 'n_events', {_r('avg(CAST(n_events AS DOUBLE))', 2)},
       {_r('stddev_samp(CAST(n_events AS DOUBLE))', 2)} FROM f WHERE intervention IS NOT NULL GROUP BY 1"""

SQL["entity_year_stats"] = f"""
SELECT l_returnflag || l_linestatus AS entity, CAST(year(l_shipdate) AS BIGINT) AS year,
       {_r('avg(l_quantity)')} AS mean, {_r('stddev_samp(l_quantity)')} AS sd,
       {_r('quantile_cont(l_quantity, 0.5)')} AS median,
       {_r('quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)')} AS iqr,
       CAST(count(l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY 1, 2"""

SQL["request_manifest"] = """
WITH y AS (SELECT l_suppkey, min(year(l_shipdate)) AS b_year, max(year(l_shipdate)) AS e_year
           FROM lineitem GROUP BY 1),
e AS (SELECT lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(s.s_nationkey AS VARCHAR), 3, '0')
             || '-' || CASE WHEN length(CAST(s.s_suppkey AS VARCHAR)) >= 4 THEN CAST(s.s_suppkey AS VARCHAR)
                       ELSE lpad(CAST(s.s_suppkey AS VARCHAR), 4, '0') END AS site_id, s.s_name, y.b_year, y.e_year
      FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN y ON s.s_suppkey = y.l_suppkey),
x AS (SELECT site_id, s_name, unnest(generate_series(b_year, e_year)) AS pull_year FROM e)
SELECT site_id, s_name, CAST(pull_year AS BIGINT) AS pull_year, split_part(site_id, '-', 1) AS state_code,
       split_part(site_id, '-', 2) AS county_code, split_part(site_id, '-', 3) AS site_code,
       CAST(pull_year AS VARCHAR) || '0101' AS bdate, CAST(pull_year AS VARCHAR) || '1231' AS edate
FROM x"""

SQL["json_flatten"] = """
SELECT event_id, event_type, CAST(count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS BIGINT) AS n_rows,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""

_HOURLY = """h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value_mean FROM events GROUP BY 1, 2),
v AS (SELECT ts, 'view' AS source, value_mean FROM h WHERE event_type = 'view'),
c AS (SELECT ts, 'click' AS source, value_mean FROM h WHERE event_type = 'click')"""

SQL["priority_dedup"] = f"""WITH {_HOURLY}
SELECT ts, source, {_r('value_mean')} AS value_mean FROM v
UNION ALL
SELECT ts, source, {_r('value_mean')} FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.ts = c.ts)"""

SQL["semi_count"] = f"""WITH {_HOURLY},
x AS (SELECT EXISTS (SELECT 1 FROM v WHERE v.ts = c.ts) AS hit FROM c)
SELECT CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS n_out
FROM x"""

SQL["dup_keys"] = """
SELECT user_id, date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS n_rows
FROM events GROUP BY 1, 2 HAVING count(*) > 1"""

SQL["covariate_join"] = f"""
WITH li AS (SELECT l_returnflag || l_linestatus AS entity, CAST(l_shipdate AS DATE) AS day, {LI_Y} AS y FROM lineitem),
daily AS (SELECT entity, day, avg(y) AS y_mean, count(*) AS n_lines FROM li GROUP BY 1, 2),
o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice,
             CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS pf FROM orders),
cov AS (SELECT day, avg(o_totalprice) AS price_mean,
               CASE WHEN count(*) FILTER (WHERE pf IS NULL OR isnan(pf)) > 0 THEN NULL ELSE avg(pf) END AS pfs
        FROM o GROUP BY 1)
SELECT d.entity, d.day, {_r('d.y_mean')} AS y_mean, CAST(d.n_lines AS BIGINT) AS n_lines,
       {_r('c.price_mean')} AS price_mean, {_r('c.pfs')} AS price_f_strict
FROM daily d LEFT JOIN cov c ON d.day = c.day"""

SQL["strict_mean"] = f"""WITH {EV_PANEL},
d AS (SELECT event_type, CAST(ts AS DATE) AS day, value_mean FROM panel)
SELECT event_type, day,
       {_r('CASE WHEN count(*) FILTER (WHERE value_mean IS NULL) > 0 THEN NULL ELSE avg(value_mean) END')} AS mean_strict,
       {_r('avg(value_mean)')} AS mean_narm,
       CAST(count(*) FILTER (WHERE value_mean IS NULL) AS BIGINT) AS n_missing
FROM d GROUP BY 1, 2"""

SQL["calendar_features"] = f"""WITH {EV_PANEL}
SELECT event_type, ts, obs_ts >= {EV_CUT} AS intervention,
       CAST(hour(obs_ts) AS BIGINT) AS time_of_day, CAST({DOW.format(t='obs_ts')} AS BIGINT) AS day_of_week,
       CAST(month(obs_ts) AS BIGINT) AS month, CAST(year(obs_ts) AS BIGINT) AS year,
       {WEEKEND.format(t='obs_ts')} AS weekend, {TOD_CAT.format(t='obs_ts')} AS time_of_day_cat,
       {SEASON.format(t='obs_ts')} AS season,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS time_elapsed
FROM panel"""

SQL["zscore_global"] = f"""WITH {EV_PANEL},
s AS (SELECT avg(value_mean) AS m1, stddev_samp(value_mean) AS s1,
             avg(n_events) AS m2, stddev_samp(n_events) AS s2 FROM panel)
SELECT event_type, ts, {_r('(value_mean - s.m1) / s.s1')} AS value_mean_scale,
       {_r('(n_events - s.m2) / s.s2')} AS n_events_scale
FROM panel CROSS JOIN s"""

SQL["zscore_entity"] = f"""WITH {EV_PANEL},
t AS (SELECT event_type, ts, date_diff('hour', (SELECT lo FROM bounds), ts) + 1 AS te FROM panel)
SELECT event_type, ts, CAST(te AS BIGINT) AS time_elapsed,
       {_r('(te - avg(te) OVER (PARTITION BY event_type)) / stddev_samp(te) OVER (PARTITION BY event_type)')}
         AS time_elapsed_scale
FROM t"""

_WIND = f"""w0 AS (SELECT event_id, ts, value - 50.0 AS u, {K} - 50.0 AS v FROM events),
w AS (SELECT event_id, ts, sqrt(u * u + v * v) AS sp, degrees(atan2(u, v)) + 180.0 AS d FROM w0)"""

SQL["wind_features"] = f"""WITH {_WIND}
SELECT event_id, {_r('sp')} AS wind_speed, {_r('d')} AS wind_dir,
       CASE WHEN d IS NULL OR isnan(d) THEN NULL
            ELSE list_extract({COMPASS}, CAST(floor(((d + 22.5) % 360.0) / 45.0) AS INTEGER) + 1) END AS wind_dir_cat
FROM w"""

SQL["wind_rose"] = f"""WITH {_WIND},
g AS (SELECT ts >= {EV_CUT} AS intervention, CAST(floor(((d + 22.5) % 360.0) / 45.0) AS BIGINT) AS sector,
             CASE WHEN sp < 3 THEN '[0,3)' WHEN sp < 6 THEN '[3,6)' WHEN sp < 9 THEN '[6,9)'
                  WHEN sp < 12 THEN '[9,12)' WHEN sp >= 12 THEN '[12,inf)' END AS speed_class,
             count(*) AS n
      FROM w WHERE d IS NOT NULL AND sp IS NOT NULL GROUP BY 1, 2, 3)
SELECT intervention, sector, speed_class, CAST(n AS BIGINT) AS n,
       {_r('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY intervention)')} AS share
FROM g"""

_MISS_COLS = ["event_type", "ts", "n_events", "value_mean", "k_mean", "obs_ts"]
SQL["missing_summary"] = f"""WITH {EV_PANEL},
c AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS m{i}' for i, c in enumerate(_MISS_COLS))}
      FROM panel)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST({i + 1} AS BIGINT) AS position, CAST(m{i} AS BIGINT) AS n_miss, "
    f"{_r(f'CAST(m{i} AS DOUBLE) * 100.0 / n')} AS pct_miss FROM c" for i, c in enumerate(_MISS_COLS))

_FEATS = f"""f AS (SELECT event_type, {WEEKEND.format(t='obs_ts')} AS weekend,
              {TOD_CAT.format(t='obs_ts')} AS time_of_day_cat FROM panel)"""

SQL["freq_table"] = f"""WITH {EV_PANEL}, {_FEATS},
s AS (SELECT 'event_type' AS variable, event_type AS value FROM f
      UNION ALL SELECT 'weekend', weekend FROM f
      UNION ALL SELECT 'time_of_day_cat', time_of_day_cat FROM f),
c AS (SELECT variable, value, count(*) AS n FROM s GROUP BY 1, 2
      UNION ALL SELECT v, NULL, 0 FROM (VALUES ('event_type'), ('weekend'), ('time_of_day_cat')) t(v))
SELECT variable, value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2"""

SQL["contingency"] = f"""WITH {EV_PANEL}, {_FEATS}
SELECT event_type, weekend, CAST(count(*) AS BIGINT) AS n FROM f
WHERE event_type IS NOT NULL AND weekend IS NOT NULL GROUP BY 1, 2"""

SQL["complete_cases"] = f"""WITH {EV_PANEL},
f AS (SELECT event_type, ts, value_mean, k_mean, obs_ts >= {EV_CUT} AS intervention,
             hour(obs_ts) AS time_of_day, {WEEKEND.format(t='obs_ts')} AS weekend FROM panel)
SELECT event_type, ts, {_r('value_mean')} AS value_mean, {_r('k_mean')} AS k_mean, intervention,
       CAST(time_of_day AS BIGINT) AS time_of_day, weekend
FROM f WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value_mean IS NOT NULL AND NOT isnan(value_mean)
  AND k_mean IS NOT NULL AND NOT isnan(k_mean) AND intervention IS NOT NULL AND time_of_day IS NOT NULL
  AND weekend IS NOT NULL"""

SQL["outlier_filter"] = """
SELECT event_id, value FROM events WHERE value < (SELECT avg(value) + 3.0 * stddev_samp(value) FROM events)"""

SQL["zone_filter"] = f"""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq,
                  avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - mq) / sq AS r, (l_extendedprice - mp) / sp AS f
      FROM lineitem CROSS JOIN s),
zz AS (SELECT *, CAST(-0.12 AS DOUBLE) * f + CAST(0.8 AS DOUBLE) AS zone FROM z)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_r('r')} AS resid_scaled, {_r('f')} AS fitted,
       {_r('zone')} AS zone
FROM zz WHERE r < 2 AND f < 2 AND r <= zone"""

SQL["corr_matrix"] = f"""WITH {EV_PANEL},
ne AS (SELECT count(DISTINCT event_type) AS k FROM panel),
ch AS (SELECT ts FROM panel GROUP BY ts HAVING count(value_mean) = (SELECT k FROM ne)),
cp AS (SELECT p.event_type, p.ts, p.value_mean FROM panel p JOIN ch ON p.ts = ch.ts),
cc AS (SELECT a.event_type AS e1, b.event_type AS e2, corr(a.value_mean, b.value_mean) AS c
       FROM cp a JOIN cp b ON a.ts = b.ts GROUP BY 1, 2),
ents AS (SELECT DISTINCT event_type FROM panel)
SELECT x.event_type AS entity_1, y.event_type AS entity_2, {_r('cc.c')} AS corr
FROM ents x CROSS JOIN ents y LEFT JOIN cc ON cc.e1 = x.event_type AND cc.e2 = y.event_type"""

SQL["histogram"] = f"""
WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
p AS (SELECT (hi - lo) / 29.0 AS w, lo - ((hi - lo) / 29.0) / 2.0 AS o FROM r),
b AS (SELECT CAST(greatest(ceil((value - o) / w) - 1, 0) AS BIGINT) AS bin, o, w FROM events CROSS JOIN p
      WHERE value IS NOT NULL AND NOT isnan(value)),
c AS (SELECT least(bin, 29) AS bin, count(*) AS n FROM b GROUP BY 1),
e AS (SELECT unnest(generate_series(0, 29)) AS bin)
SELECT CAST(e.bin AS BIGINT) AS bin, {_r('p.o + e.bin * p.w')} AS x_min, {_r('p.o + (e.bin + 1) * p.w')} AS x_max,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM e CROSS JOIN p LEFT JOIN c ON e.bin = c.bin"""

SQL["box_stats"] = f"""
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
j AS (SELECT e.value, f.*, (e.value >= f.lower_fence AND e.value <= f.upper_fence) AS inside
      FROM events e JOIN f ON e.event_type = f.event_type WHERE e.value IS NOT NULL)
SELECT event_type, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3,
       {_r('lower_fence')} AS lower_fence, {_r('upper_fence')} AS upper_fence,
       {_r('min(CASE WHEN inside THEN value END)')} AS whisker_lo,
       {_r('max(CASE WHEN inside THEN value END)')} AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT inside) AS BIGINT) AS n_out, CAST(count(*) AS BIGINT) AS n
FROM j GROUP BY event_type, q1, median, q3, lower_fence, upper_fence"""

SQL["rolling_mean"] = f"""WITH {EV_PANEL},
d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value_mean) AS day_mean FROM panel GROUP BY 1, 2)
SELECT event_type, day, {_r('day_mean')} AS day_mean,
       {_r('CASE WHEN count(*) OVER w = 14 THEN avg(day_mean) OVER w END')} AS roll14
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""

SQL["acf"] = f"""WITH {EV_PANEL},
x AS (SELECT event_type, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) + 1 AS idx, value_mean AS v
      FROM panel WHERE value_mean IS NOT NULL AND NOT isnan(value_mean)),
m AS (SELECT event_type, avg(v) AS mu FROM x GROUP BY 1),
c AS (SELECT x.event_type, x.idx, x.v - m.mu AS c FROM x JOIN m ON x.event_type = m.event_type),
lags AS (SELECT unnest(range(0, 101)) AS lag),
pr AS (SELECT a.event_type, l.lag, sum(a.c * b.c) AS s, count(*) AS nu
       FROM c a CROSS JOIN lags l JOIN c b ON b.event_type = a.event_type AND b.idx = a.idx + l.lag
       GROUP BY 1, 2),
g AS (SELECT e.event_type, l.lag, coalesce(pr.nu, 0) AS nu,
             CASE WHEN coalesce(pr.nu, 0) > 0 THEN pr.s / (pr.nu + l.lag) END AS gamma
      FROM (SELECT DISTINCT event_type FROM c) e CROSS JOIN lags l
      LEFT JOIN pr ON pr.event_type = e.event_type AND pr.lag = l.lag)
SELECT event_type, CAST(lag AS BIGINT) AS lag,
       {_r('gamma / first_value(gamma) OVER (PARTITION BY event_type ORDER BY lag)')} AS acf,
       CAST(nu AS BIGINT) AS n_pairs
FROM g"""

SQL["impute_cell_mean"] = f"""WITH {EV_PANEL},
p AS (SELECT *, year(ts) AS year, {SEASON.format(t='ts')} AS season, {DOW.format(t='ts')} AS day_of_week,
             hour(ts) AS time_of_day FROM panel),
cells AS (SELECT year, season, day_of_week, time_of_day, avg(value_mean) AS impute_value FROM p GROUP BY 1, 2, 3, 4),
j AS (SELECT p.event_type, p.ts,
             CASE WHEN p.value_mean IS NULL OR isnan(p.value_mean) THEN c.impute_value ELSE p.value_mean END
               AS value_imputed, c.impute_value
      FROM p LEFT JOIN cells c ON p.year IS NOT DISTINCT FROM c.year AND p.season IS NOT DISTINCT FROM c.season
        AND p.day_of_week IS NOT DISTINCT FROM c.day_of_week AND p.time_of_day IS NOT DISTINCT FROM c.time_of_day)
SELECT event_type, ts, {_r('value_imputed')} AS value_imputed, {_r('impute_value')} AS impute_value FROM j
WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value_imputed IS NOT NULL AND NOT isnan(value_imputed)"""

SQL["descriptives"] = f"""WITH {EV_PANEL}
SELECT {_r('avg(value_mean)')} AS mean, {_r('quantile_cont(value_mean, 0.5)')} AS median,
       {_r('stddev_samp(value_mean)')} AS sd,
       {_r('quantile_cont(value_mean, 0.75) - quantile_cont(value_mean, 0.25)')} AS iqr,
       CAST(count(value_mean) AS BIGINT) AS n
FROM panel"""

SQL["column_summary"] = f"""WITH {EV_PANEL}
SELECT event_type, {_r('min(value_mean)')} AS min, {_r('quantile_cont(value_mean, 0.25)')} AS q1,
       {_r('quantile_cont(value_mean, 0.5)')} AS median, {_r('avg(value_mean)')} AS mean,
       {_r('quantile_cont(value_mean, 0.75)')} AS q3, {_r('max(value_mean)')} AS max,
       CAST(count(*) FILTER (WHERE value_mean IS NULL) AS BIGINT) AS n_na
FROM panel GROUP BY 1"""

SQL["time_window"] = """
SELECT event_id, ts, event_type FROM events
WHERE ts > TIMESTAMP '2024-01-03 04:00:00' AND ts < TIMESTAMP '2024-01-28 05:00:00'
  AND NOT coalesce(event_type IN ('error', 'signup'), false)"""

SQL["qq_points"] = f"""
WITH v AS (SELECT value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
n AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v),
r AS (SELECT v.value, row_number() OVER (ORDER BY v.value) AS rk FROM v),
p AS (SELECT r.value, (CAST(r.rk AS DOUBLE) - CASE WHEN n.n <= 10 THEN 0.375 ELSE 0.5 END)
              / (CAST(n.n AS DOUBLE) + 1.0 - 2.0 * CASE WHEN n.n <= 10 THEN 0.375 ELSE 0.5 END) AS pp,
             (n.q3 - n.q1) / CAST(1.3489795003921634 AS DOUBLE) AS slope, n.q1
      FROM r CROSS JOIN n)
SELECT value AS sample, {_r(norm_quantile_sql('pp'))} AS theoretical, {_r('slope')} AS line_slope,
       {_r('q1 - slope * CAST(-0.6744897501960817 AS DOUBLE)')} AS line_intercept
FROM p"""

_LI_BASE = f"""li AS (
  SELECT l_returnflag || l_linestatus AS entity, CAST(l_shipdate >= {LI_CUT} AS DOUBLE) AS post,
         CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t,
         round(l_discount * 100) AS disc, {LI_Y} AS y
  FROM lineitem)"""

_GT = [("(Intercept)", "1.0"), ("post", "post"), ("t", "t"), ("disc", "disc"), ("y", "y")]
SQL["gram_matrix"] = f"WITH {_LI_BASE}\n" + "\nUNION ALL\n".join(
    f"SELECT entity, '{a}' AS row_term, '{b}' AS col_term, {_r(f'sum(({ea}) * ({eb}))')} AS value FROM li GROUP BY entity"
    for i, (a, ea) in enumerate(_GT) for (b, eb) in _GT[i:])

SQL["ols_simple"] = f"""WITH {_LI_BASE}
SELECT entity AS stratum, '(Intercept)' AS term, {_r('regr_intercept(y, t)')} AS beta FROM li GROUP BY entity
UNION ALL
SELECT entity, 't', {_r('regr_slope(y, t)')} FROM li GROUP BY entity"""

SQL["lmm_profile_grid"] = f"""WITH {_LI_BASE},
e AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n, sum(post) AS a, sum(y) AS sy, sum(post * y) AS spy,
             sum(y * y) AS syy FROM li GROUP BY 1),
th AS (SELECT unnest([0.0, 0.0001, 0.001, 0.01, 0.1, 1.0]::DOUBLE[]) AS theta),
w AS (SELECT th.theta, e.*, th.theta / (1.0 + e.n * th.theta) AS w FROM e CROSS JOIN th),
m AS (SELECT theta, sum(n) - sum(w * n * n) AS m00, sum(a) - sum(w * n * a) AS m01, sum(a) - sum(w * a * a) AS m11,
             sum(sy) - sum(w * n * sy) AS r0, sum(spy) - sum(w * a * sy) AS r1, sum(syy) - sum(w * sy * sy) AS myy,
             sum(n) AS nn, sum(ln(1.0 + n * theta)) AS ld
      FROM w GROUP BY theta),
b AS (SELECT *, (m11 * r0 - m01 * r1) / (m00 * m11 - m01 * m01) AS b0,
                (m00 * r1 - m01 * r0) / (m00 * m11 - m01 * m01) AS b1 FROM m)
SELECT {_r('theta')} AS theta, {_r('b0')} AS beta_int, {_r('b1')} AS beta_post,
       {_r('-nn / 2.0 * (ln(2.0 * pi()) + ln((myy - b0 * r0 - b1 * r1) / nn) + 1.0) - ld / 2.0')} AS loglik
FROM b"""

SQL["grid_year_files"] = f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT year(o_orderdate) AS y, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi
      FROM orders WHERE o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY 1)
SELECT p.y AS year, month(day) AS month, count(*) AS days, CAST(sum(n) AS BIGINT) AS n, ROUNDED AS price_mean
FROM d JOIN p ON year(day) = p.y AND day BETWEEN lo AND hi GROUP BY 1, 2""".replace(
    "ROUNDED", "(floor(floor(avg(price) * 1e9 + 0.5) / 1e9 * 1e4 + 0.5) / 1e4)")

SQL["csv_landing"] = f"""WITH {EV_PANEL}
SELECT event_type, ts, event_type || '_' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS entity_key,
       {_r('CASE WHEN value_mean < 40 THEN 0.1 ELSE value_mean END')} AS value_clamped, {_r('k_mean')} AS k_mean FROM obs"""
SQL["response_files"] = f"""WITH {EV_PANEL}
SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS hour, n_events AS n, {_r('value_mean')} AS value_mean, 'Success' AS status,
       count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS n_rows FROM obs"""
SQL["grid_files"] = f"""WITH {EV_PANEL}
SELECT date_trunc('day', ts) AS ts, strftime(ts, '%Y') AS year, strftime(ts, '%Y%m%d') AS day, hour(ts) AS x,
       CAST(ascii(event_type) AS BIGINT) AS y, {_r('value_mean')} AS value, n_events AS events FROM obs"""
SQL["not_in_nulls"] = f"""WITH {EV_PANEL},
w AS (SELECT event_type, ts, {WEEKEND.format(t='obs_ts')} AS weekend FROM panel)
SELECT * FROM w WHERE weekend IS NULL OR weekend <> 'weekend'"""
SQL["series_lookup"] = f"""WITH {EV_PANEL},
p AS (SELECT date_diff('hour', (SELECT lo FROM bounds), ts) + 1 AS idx, ts, value_mean FROM panel)
SELECT idx, ts, CAST(ts AS DATE) AS date, {_r('avg(value_mean)')} AS value_mean, count(value_mean) AS n_types FROM p GROUP BY 1, 2"""
