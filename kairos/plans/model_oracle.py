"""DuckDB SQL of random-intercept fits: sums per entity, the stated grid search, a Cholesky solve.

For a ratio θ = v² of intercept to residual variance, with G the sum of squares and
products of [1, x..., y] and s_i the column sums of entity i (n_i rows),

    M = G − Σ_i θ/(1 + n_i θ) s_i s_iᵀ

gives β, the residual sum of squares and the profile likelihood.  The search is the library's:
v = 0 and 160 points from 1e-4 to 1e3 evenly spaced in the logarithm, then twice 161 even
points between the neighbours of the best.
"""

from __future__ import annotations

from collections.abc import Sequence

from kairos.plans.oracle import EV_CUT, EV_PANEL, K, LI_CUT, LI_Y, SEASON, SQL as BASE_SQL, WEEKEND, norm_quantile_sql

POINTS = 160


def r(x: str, d: int = 4) -> str:
    return f"(floor(floor(({x}) * 1e9 + 0.5) / 1e9 * 1e{d} + 0.5) / 1e{d})"


def random_intercept(name: str, rows: str, xs: Sequence[str], method: str = "ML", scaled: bool = True,
                     search: bool = True) -> str:
    """CTEs ending in {name}_best: per stratum s the coefficients b0.., their se, v, n.

    ``rows`` names a CTE (s, e, xs..., y) without nulls.  If ``scaled``, columns are centred and scaled by their overall
    moments, but for flags, whose names start with an underscore.  Without ``search``, v is 0 (least squares)."""
    cols = ["1.0", *[x if x.startswith("_") or not scaled else f"(({x}) - mu_{x}) / sd_{x}" for x in xs], "y"]
    m = len(cols)
    tri = [(i, j) for i in range(m) for j in range(i + 1)]
    moments = [x for x in xs if not x.startswith("_")]
    mom = ", ".join(f"avg({x}) AS mu_{x}, stddev_samp({x}) AS sd_{x}" for x in moments) or "1 AS one"
    p = m - 1
    ctes = [f"{name}_mom AS (SELECT {mom} FROM {rows})",
            f"{name}_a AS (SELECT s, e, {', '.join(f'CAST({c} AS DOUBLE) AS a{i}' for i, c in enumerate(cols))} "
            f"FROM {rows} CROSS JOIN {name}_mom)",
            f"{name}_e AS (SELECT s, e, {', '.join(f'sum(a{i} * a{j}) AS g{i}_{j}' for i, j in tri)} "
            f"FROM {name}_a GROUP BY 1, 2)",
            f"{name}_c0 AS (SELECT DISTINCT s, i, CASE WHEN i = 0 THEN 0.0 ELSE power(10.0, -4.0 + 7.0 * (i - 1) / "
            f"{POINTS - 1}.0) END AS v FROM {name}_e CROSS JOIN (SELECT unnest(range({POINTS + 1 if search else 1})) AS i))"]
    for k in range(3 if search else 1):
        c, q = f"{name}_c{k}", f"{name}_q{k}"
        adj = ", ".join(f"sum(g{i}_{j} - v * v / (1 + v * v * g0_0) * g{max(i, 0)}_0 * g{max(j, 0)}_0) AS m{i}_{j}"
                        for i, j in tri)
        ctes.append(f"{q}m AS (SELECT c.s, c.i, c.v, sum(g0_0) AS n, sum(ln(1 + v * v * g0_0)) AS ld, {adj} "
                    f"FROM {c} c JOIN {name}_e e ON c.s = e.s GROUP BY 1, 2, 3)")
        last = f"{q}m"
        for i in range(m):           # one row of the Cholesky factor at a time; the last row holds L⁻¹Mxy and the rss
            for j in range(i + 1):
                e = f"m{i}_{j}" + "".join(f" - l{i}_{t} * l{j}_{t}" for t in range(j))
                e = f"sqrt({e})" if i == j and i < p else e if i == j else f"({e}) / l{j}_{j}"
                ctes.append(f"{q}_{i}_{j} AS (SELECT *, {e} AS l{i}_{j} FROM {last})")
                last = f"{q}_{i}_{j}"
        logs = " + ".join(f"ln(l{i}_{i})" for i in range(p))
        rss = f"l{p}_{p}"
        ll = (f"-n / 2.0 * ln({rss} / n) - ld / 2.0" if method == "ML" else
              f"-(n - {p}) / 2.0 * ln({rss} / (n - {p})) - ld / 2.0 - ({logs})")
        ctes.append(f"{q} AS (SELECT *, {ll} AS ll FROM {last})")
        ctes.append(f"{q}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ll DESC, i) AS rk "
                    f"FROM {q}) WHERE rk = 1)")
        if k < 2 and search:
            top = POINTS
            ctes.append(
                f"{name}_n{k} AS (SELECT b.s, coalesce((SELECT v FROM {c} x WHERE x.s = b.s AND x.i = b.i - 1), 0.0) AS lo, "
                f"coalesce((SELECT v FROM {c} x WHERE x.s = b.s AND x.i = b.i + 1), b.v * 4.0) AS hi FROM {q}b b)")
            ctes.append(f"{name}_c{k + 1} AS (SELECT s, i, lo + (hi - lo) * i / {top}.0 AS v FROM {name}_n{k} "
                        f"CROSS JOIN (SELECT unnest(range({top + 1})) AS i))")
    # back substitution for β and columns of L⁻¹ for the standard errors
    last, q = f"{name}_q{2 if search else 0}b", f"{name}_z"
    for i in range(p - 1, -1, -1):
        e = f"(l{p}_{i}" + "".join(f" - l{t}_{i} * b{t}" for t in range(i + 1, p)) + f") / l{i}_{i}"
        ctes.append(f"{q}b{i} AS (SELECT *, {e} AS b{i} FROM {last})")
        last = f"{q}b{i}"
    for j in range(p):
        for i in range(j, p):
            e = f"1.0 / l{i}_{i}" if i == j else "-(" + " + ".join(f"l{i}_{t} * w{t}_{j}" for t in range(j, i)) + f") / l{i}_{i}"
            ctes.append(f"{q}w{i}_{j} AS (SELECT *, {e} AS w{i}_{j} FROM {last})")
            last = f"{q}w{i}_{j}"
    # ML: variance with n - p degrees, as the library reports it by default; REML has them already
    ctes.append(f"{name}_best AS (SELECT s, v, CAST(n AS BIGINT) AS n, {', '.join(f'b{i}' for i in range(p))}, "
                + ", ".join(f"sqrt(l{p}_{p} / (n - {p}) * (" + " + ".join(f"w{i}_{j} * w{i}_{j}" for i in range(j, p))
                            + f")) AS se{j}" for j in range(p)) + f" FROM {last})")
    return ",\n".join(ctes)


def effect(name: str, rows: str, xs: Sequence[str], model: str, method: str = "ML") -> str:
    return (f"{random_intercept(name, rows, xs, method)}\nSELECT '{model}' AS model, s AS stratum, n, {r('b1')} AS beta, "
            f"{r('se1')} AS se FROM {name}_best")


_T = "date_diff('hour', (SELECT lo FROM bounds), ts) + 1.0"
_POST = "CASE WHEN ts >= {0} THEN 1.0 ELSE 0.0 END"
_MAIN = f"WITH {EV_PANEL},\n"
_CUT = "TIMESTAMP '2024-01-15 00:00:00'"

_PM = f"""pm AS (SELECT ts, value_mean AS pm FROM obs WHERE event_type = 'click'),
wp AS (SELECT 'all' AS s, event_type AS e, {_POST.format(EV_CUT)} AS _post, {_T} AS t, pm.pm, value_mean AS y
       FROM panel JOIN pm USING (ts) WHERE value_mean IS NOT NULL AND pm.pm IS NOT NULL)"""

SQL: dict[str, str] = {}
SQL["same_rows_unadjusted"] = _MAIN + _PM + ",\n" + effect("f", "wp", ["_post", "t"], "same_rows")
SQL["pm_adjusted"] = (
    _MAIN + _PM + ",\n" + random_intercept("h", "wp", ["pm"]) + """,
fit AS (SELECT w.*, h.b0 + h.b1 * (w.pm - h_mom.mu_pm) / h_mom.sd_pm AS xb, h.v FROM wp w JOIN h_best h ON w.s = h.s CROSS JOIN h_mom),
bl AS (SELECT e, sum(y - xb) * max(v * v) / (1 + max(v * v) * count(*)) AS b FROM fit GROUP BY 1),
wr AS (SELECT fit.s, fit.e, fit._post, fit.t, fit.y, fit.y - fit.xb - bl.b AS res FROM fit JOIN bl ON fit.e = bl.e),
""" + effect("f", "wr", ["_post", "t", "res"], "pm_adjusted"))
SQL["moved_cut"] = _MAIN + f"""mc AS (SELECT 'all' AS s, event_type AS e, {_POST.format(_CUT)} AS _post, {_T} AS t,
  value_mean AS y FROM panel WHERE value_mean IS NOT NULL),
""" + effect("f", "mc", ["_post", "t"], "moved_cut")
SQL["entity_subset"] = _MAIN + f"""es AS (SELECT 'all' AS s, event_type AS e, {_POST.format(EV_CUT)} AS _post, {_T} AS t,
  value_mean AS y FROM panel WHERE value_mean IS NOT NULL AND event_type NOT IN ('error', 'signup')),
""" + effect("f", "es", ["_post", "t"], "subset", "REML")
_CELL = "year(ts) AS c1, " + SEASON.format(t="ts") + " AS c2, dayofweek(ts) AS c3, hour(ts) AS c4"
SQL["imputed_refit"] = _MAIN + f"""ic AS (SELECT *, {_CELL} FROM panel),
im AS (SELECT c1, c2, c3, c4, avg(value_mean) AS fill FROM ic GROUP BY 1, 2, 3, 4),
ir AS (SELECT 'all' AS s, event_type AS e, {_POST.format(EV_CUT)} AS _post, {_T} AS t, coalesce(value_mean, fill) AS y
       FROM ic JOIN im USING (c1, c2, c3, c4) WHERE coalesce(value_mean, fill) IS NOT NULL),
""" + effect("f", "ir", ["_post", "t"], "imputed")


def _pos(x: str, k: str) -> str:
    return f"power(greatest({x} - {k}, 0.0), 3)"


def _d(j: int) -> str:
    return f"(({_pos('x', f'k{j}')} - {_pos('x', 'k3')}) / (k3 - k{j}))"


SQL["spline_mixed"] = _MAIN + f"""sr AS (SELECT event_type AS e, {_POST.format(EV_CUT)} AS _post, {_T} AS t, k_mean AS x,
  CAST(n_events AS DOUBLE) AS n1, value_mean AS y FROM panel WHERE value_mean IS NOT NULL AND k_mean IS NOT NULL AND n_events IS NOT NULL),
kn AS (SELECT quantile_cont(x, 0.0) AS k0, quantile_cont(x, 1.0 / 3) AS k1, quantile_cont(x, 2.0 / 3) AS k2, quantile_cont(x, 1.0) AS k3 FROM sr),
sb AS (SELECT 'all' AS s, e, _post, t, x AS ns1, {_d(0)} - {_d(2)} AS ns2, {_d(1)} - {_d(2)} AS ns3, n1, n1 * n1 AS n2, y FROM sr CROSS JOIN kn),
""" + effect("f", "sb", ["_post", "t", "ns1", "ns2", "ns3", "n1", "n2"], "spline")

_FEATS = f"""mf AS (SELECT event_type AS e, ts, CASE WHEN obs_ts >= {EV_CUT} THEN 1.0 ELSE 0.0 END AS _post, k_mean AS k, value_mean AS y,
  CAST(hour(obs_ts) AS VARCHAR) AS h, {WEEKEND.format(t='obs_ts')} AS w FROM panel
  WHERE value_mean IS NOT NULL AND k_mean IS NOT NULL AND obs_ts IS NOT NULL)"""
_ROAD = """rd AS (SELECT CASE WHEN e IN ('view', 'click') THEN 'Roadside' ELSE 'Non-roadside' END AS s, e, _post,
  CAST(row_number() OVER (PARTITION BY e ORDER BY ts) AS DOUBLE) AS t, k, y FROM mf)"""
_HOUR = """hr AS (SELECT h AS s, e, _post, CAST(row_number() OVER (PARTITION BY h, e ORDER BY ts) AS DOUBLE) AS t, k, y FROM mf)"""
SQL["roadside_effects"] = f"{_MAIN}{_FEATS},\n{_ROAD},\n" + effect("f", "rd", ["_post", "t", "k"], "roadside")
SQL["hourly_effects"] = (
    f"{_MAIN}{_FEATS},\n{_HOUR},\n" + random_intercept("f", "hr", ["_post", "t", "k"])
    + f"""\nSELECT 'strata_time_of_day' AS model, s AS stratum, {r('b1')} AS beta, {r('se1')} AS se,
  {r('b1 - 1.96 * se1', 3)} AS lci, {r('b1 + 1.96 * se1', 3)} AS uci FROM f_best""")


def _pair(one: str, two: str, a: str, b: str) -> str:
    wald, v1, v2 = "(x.b1 - y.b1) / sqrt(x.se1 * x.se1 + y.se1 * y.se1)", "(x.se1 * x.se1)", "(y.se1 * y.se1)"
    pooled = f"((x.b1 / {v1} + y.b1 / {v2}) / (1 / {v1} + 1 / {v2}))"
    return (f"SELECT '{a}' AS s1, '{b}' AS s2, {r(wald, 3)} AS wald, {r(pooled, 3)} AS pooled_beta, "
            f"{r(f'(x.b1 - {pooled}) * (x.b1 - {pooled}) / {v1} + (y.b1 - {pooled}) * (y.b1 - {pooled}) / {v2}', 3)} "
            f"AS cochran FROM {one} x, {two} y WHERE x.s = '{a}' AND y.s = '{b}'")


SQL["het_pairs"] = (f"{_MAIN}{_FEATS},\n{_HOUR},\n{_ROAD},\n" + random_intercept("f", "hr", ["_post", "t", "k"]) + ",\n"
                    + random_intercept("g", "rd", ["_post", "t", "k"]) + "\n" + _pair("f_best", "f_best", "1", "6")
                    + "\nUNION ALL\n" + _pair("g_best", "g_best", "Roadside", "Non-roadside"))


# The main model on line items: post, day index, discount and weekday (reference level Sunday = 1).
_LI_X = ["_post", "t", "disc", *[f"_d{i}" for i in range(2, 8)]]
_LI_TERMS = ["(Intercept)", "post", "t", "disc", *[f"dow{i}" for i in range(2, 8)]]
_LI = f"""WITH li AS (SELECT 'all' AS s, l_returnflag || l_linestatus AS e, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_shipdate >= {LI_CUT} THEN 1.0 ELSE 0.0 END AS _post,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t,
  round_even(l_discount * 100, 0) AS disc, {LI_Y} AS y,
  {', '.join(f"CASE WHEN dayofweek(l_shipdate) + 1 = {i} THEN 1.0 ELSE 0.0 END AS _d{i}" for i in range(2, 8))}
  FROM lineitem),
"""


def _coefs(name: str, model: str, terms: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{model}' AS model, s AS stratum, '{t}' AS term, {r(f'b{i}', 6)} AS beta, {r(f'se{i}', 6)} AS se, "
        f"{r(f'b{i} - 1.96 * se{i}', 6)} AS lci, {r(f'b{i} + 1.96 * se{i}', 6)} AS uci FROM {name}_best"
        for i, t in enumerate(terms))


def _linear(xs: Sequence[str]) -> str:
    return "m.b0" + "".join(f" + m.b{i + 1} * w.{x}" for i, x in enumerate(xs))


def _scored(name: str, fit: str, rows: str, xs: Sequence[str]) -> str:
    """{name}: the rows with xb, BLUP b and residual res of an unscaled one-stratum fit."""
    return f"""{name}x AS (SELECT w.*, {_linear(xs)} AS xb, m.v * m.v AS th FROM {rows} w JOIN {fit}_best m ON w.s = m.s),
{name}b AS (SELECT e, sum(y - xb) * max(th) / (1 + max(th) * count(*)) AS b FROM {name}x GROUP BY 1),
{name} AS (SELECT x.*, b.b, x.y - x.xb - b.b AS res FROM {name}x x JOIN {name}b b ON x.e = b.e)"""


_LI_FIT = _LI + random_intercept("f", "li", _LI_X, scaled=False)
SQL["lmm_effect"] = _LI_FIT + "\n" + _coefs("f", "ri_ml", _LI_TERMS)
SQL["lmm_reml"] = _LI + random_intercept("f", "li", _LI_X, "REML", scaled=False) + "\n" + _coefs("f", "ri_reml", _LI_TERMS)
SQL["lmm_ranef"] = (_LI_FIT + ",\n" + _scored("z", "f", "li", _LI_X) + f"""
SELECT DISTINCT 'ri_ml' AS model, 'all' AS stratum, e AS entity, '(Intercept)' AS term, {r('b')} AS blup FROM zb""")
SQL["its_counterfactual"] = (_LI_FIT + ",\n" + _scored("z", "f", "li", _LI_X) + f""",
pr AS (SELECT z.t, z.day, z.xb + z.b AS act, z.xb + z.b - m.b1 * z._post AS cf FROM z JOIN f_best m ON z.s = m.s),
ti AS (SELECT t, avg(act) AS act, avg(cf) AS cf, min(day) AS day FROM pr GROUP BY 1),
dy AS (SELECT day, avg(act) AS act, avg(cf) AS cf FROM ti GROUP BY 1)
SELECT day AS date, {r('act')} AS pred_actual, {r('cf')} AS pred_counterf,
       {r('CASE WHEN count(*) OVER w = 14 THEN avg(act) OVER w END')} AS roll_actual,
       {r('CASE WHEN count(*) OVER w = 14 THEN avg(cf) OVER w END')} AS roll_counterf
FROM dy WINDOW w AS (ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
SQL["stored_scores"] = (_LI_FIT + ",\n" + _scored("z", "f", "li", _LI_X) + f"""
SELECT z.e AS entity, CAST(z._post AS INTEGER) AS post, count(*) AS n, {r('avg(z.xb + z.b)')} AS actual,
       {r('avg(z.xb + z.b - m.b1 * z._post)')} AS counterf, {r('avg(z.res)')} AS resid
FROM z JOIN f_best m ON z.s = m.s GROUP BY 1, 2""")

_DT_X = ["disc", *[f"_d{i}" for i in range(2, 8)]]
SQL["detrend_effect"] = (
    _LI + "lf AS (SELECT * REPLACE (_post AS y) FROM li),\n" + random_intercept("g", "li", _DT_X, "REML", scaled=False)
    + ",\n" + random_intercept("h", "lf", _DT_X, "REML", scaled=False) + f""",
gx AS (SELECT w.*, {_linear(_DT_X)} AS xb, m.v * m.v AS th FROM li w JOIN g_best m ON w.s = m.s),
gb AS (SELECT e, sum(y - xb) * max(th) / (1 + max(th) * count(*)) AS b FROM gx GROUP BY 1),
hx AS (SELECT w.*, {_linear(_DT_X)} AS fx, m.v * m.v AS fh FROM gx w JOIN h_best m ON w.s = m.s),
hb AS (SELECT e, sum(_post - fx) * max(fh) / (1 + max(fh) * count(*)) AS b FROM hx GROUP BY 1),
dr AS (SELECT 'all' AS s, 'all' AS e, hx._post - hx.fx - hb.b AS x, hx.t, hx.y - hx.xb - gb.b AS y
       FROM hx JOIN gb ON hx.e = gb.e JOIN hb ON hx.e = hb.e),
""" + random_intercept("o", "dr", ["x", "t"], scaled=False, search=False) + "\n"
    + _coefs("o", "detrended", ["(Intercept)", "flag_resid", "t"]))

_EV_X = ["_post", "t", "k"]
SQL["residual_outliers"] = f"""WITH ev AS (SELECT 'all' AS s, event_type AS e, CASE WHEN ts >= {EV_CUT} THEN 1.0 ELSE 0.0 END AS _post,
  floor(date_diff('second', {EV_CUT}, ts) / 3600.0) + 1 AS t, {K} AS k, value AS y FROM events),
er AS (SELECT * FROM ev WHERE _post IS NOT NULL AND t IS NOT NULL AND k IS NOT NULL AND y IS NOT NULL AND e IS NOT NULL),
""" + random_intercept("f", "er", _EV_X, scaled=False) + ",\n" + _scored("z", "f", "er", _EV_X) + """,
ek AS (SELECT s, e, _post, t, k, y FROM z WHERE res < (SELECT avg(y) + 3.0 * stddev_samp(y) FROM er)),
""" + random_intercept("g", "ek", _EV_X, scaled=False) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS model, s AS stratum, {r('b1')} AS beta, {r('se1')} AS se, {r('b1 - 1.96 * se1')} AS lci, "
    f"{r('b1 + 1.96 * se1')} AS uci, n FROM {c}_best" for c, m in (("f", "ri_ml"), ("g", "ri_ml_no_outliers")))

SQL["trend_smoother"] = _MAIN + f"""tp AS (SELECT event_type AS s, 'all' AS e, ts, {_T} AS x, value_mean AS y FROM panel),
kn AS (SELECT quantile_cont(x, 0.0) AS k0, quantile_cont(x, 1.0 / 3) AS k1, quantile_cont(x, 2.0 / 3) AS k2,
              quantile_cont(x, 1.0) AS k3 FROM tp WHERE y IS NOT NULL),
tb AS (SELECT tp.*, x / 1.0 AS ns1, {_d(0)} - {_d(2)} AS ns2, {_d(1)} - {_d(2)} AS ns3 FROM tp CROSS JOIN kn),
tc AS (SELECT * FROM tb WHERE y IS NOT NULL),
""" + random_intercept("f", "tc", ["ns1", "ns2", "ns3"], search=False) + f"""
SELECT w.s AS event_type, w.ts, {r('w.y', 6)} AS value_mean, {r("m.b0 + " + " + ".join(
    f"m.b{i} * (w.ns{i} - f_mom.mu_ns{i}) / f_mom.sd_ns{i}" for i in (1, 2, 3)))} AS trend
FROM tb w JOIN f_best m ON w.s = m.s CROSS JOIN f_mom"""

# Durbin–Levinson over the lags 0..30 of the ACF, with the ACF of the panel as in its own query.
_ACF = BASE_SQL["acf"]
SQL["pacf"] = f"""WITH RECURSIVE a AS (SELECT event_type, lag, acf FROM ({{acf}}) WHERE lag <= 30),
rl AS (SELECT event_type, list(acf ORDER BY lag) AS r FROM a GROUP BY 1),
dl AS (SELECT event_type, r, CAST(1 AS BIGINT) AS k, [r[2]] AS phi, 1.0 - r[2] * r[2] AS v FROM rl
       UNION ALL
       SELECT event_type, r, k + 1,
              list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - g * phi[k + 1 - j]), [g]), v * (1.0 - g * g)
       FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j]))) / v AS g
             FROM dl WHERE k < 30))
SELECT event_type, k AS lag, {r('phi[k]')} AS pacf FROM dl""".replace("{acf}", _ACF)

# Residuals of the main model on the hourly panel.
_RES = _MAIN + f"""rm AS (SELECT 'all' AS s, event_type AS e, {_POST.format(EV_CUT)} AS _post, {_T} AS t, k_mean AS k, value_mean AS y
  FROM panel WHERE value_mean IS NOT NULL AND k_mean IS NOT NULL),
""" + random_intercept("f", "rm", ["_post", "t", "k"], scaled=False) + ",\n" + _scored("z", "f", "rm", ["_post", "t", "k"])
SQL["residual_box"] = _RES + f""",
q AS (SELECT e, quantile_cont(res, 0.25) AS q1, quantile_cont(res, 0.5) AS md, quantile_cont(res, 0.75) AS q3 FROM z GROUP BY 1),
l AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l.e AS event_type, {r('q1')} AS q1, {r('md')} AS median, {r('q3')} AS q3, {r('lo')} AS lower_fence, {r('hi')} AS upper_fence,
       CAST(count(*) FILTER (WHERE res < lo OR res > hi) AS BIGINT) AS n_out, CAST(count(*) AS BIGINT) AS n
FROM z JOIN l ON z.e = l.e GROUP BY l.e, q1, md, q3, lo, hi"""
SQL["residual_zone"] = _RES + f""",
sc AS (SELECT avg(res) AS m1, stddev_samp(res) AS s1, avg(xb + b) AS m2, stddev_samp(xb + b) AS s2 FROM z),
zs AS (SELECT z.e, z.res, (z.res - m1) / s1 AS u, (z.xb + z.b - m2) / s2 AS w FROM z CROSS JOIN sc)
SELECT e AS event_type, count(*) AS n, {r('avg(res)')} AS mean_resid FROM zs WHERE u < 2 AND w < 2 AND u <= -0.12 * w + 0.8 GROUP BY 1"""
SQL["residual_acf"] = _RES + f""",
ms AS (SELECT e, avg(res) AS mu FROM z GROUP BY 1),
cx AS (SELECT z.e, CAST(z.t AS BIGINT) AS i, z.res - ms.mu AS c FROM z JOIN ms ON z.e = ms.e),
lg AS (SELECT unnest(range(31)) AS lag),
sm AS (SELECT a.e, g.lag, sum(a.c * d.c) AS sp, count(*) AS nu FROM cx a CROSS JOIN lg g JOIN cx d ON d.e = a.e AND d.i = a.i + g.lag GROUP BY 1, 2),
gm AS (SELECT *, sp / (nu + lag) AS g FROM sm)
SELECT gm.e AS event_type, CAST(gm.lag AS BIGINT) AS lag, {r('gm.g / g0.g')} AS acf, CAST(gm.nu AS BIGINT) AS n_pairs
FROM gm JOIN (SELECT e, g FROM gm WHERE lag = 0) g0 ON gm.e = g0.e"""
SQL["residual_qq"] = _RES + f""",
n AS (SELECT count(*) AS n, quantile_cont(res, 0.25) AS q1, quantile_cont(res, 0.75) AS q3 FROM z),
k AS (SELECT res, row_number() OVER (ORDER BY res) AS rk FROM z),
p AS (SELECT k.res, k.rk, (CAST(k.rk AS DOUBLE) - 0.5) / CAST(n.n AS DOUBLE) AS pp,
             (n.q3 - n.q1) / CAST(1.3489795003921634 AS DOUBLE) AS slope, n.q1 FROM k CROSS JOIN n)
SELECT CAST(rk AS BIGINT) AS rank, {r('res')} AS sample, {r(norm_quantile_sql('pp'), 6)} AS theoretical, {r('slope')} AS line_slope,
       {r('q1 - slope * CAST(-0.6744897501960817 AS DOUBLE)')} AS line_intercept FROM p"""
