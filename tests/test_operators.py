"""Panel, descriptive and series operators vs brute force on small fixtures."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from kairos.operators import describe as D
from kairos.operators import features as FE
from kairos.operators import panel as P
from kairos.operators import series as S


def _obs(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h), float(h)) for h in range(0, 48) if h not in (5, 6)]
    rows += [("b", t0 + dt.timedelta(hours=h), None if h == 4 else 2.0 * h) for h in range(0, 48, 2)]
    return spark.createDataFrame(rows, "e string, ts timestamp_ntz, v double")


def test_panel_completion_size(spark):
    obs = _obs(spark)
    p = P.complete_panel(obs, ["e"], "ts", "2024-01-01 00:00:00", "2024-01-02 23:00:00")
    assert p.count() == 2 * 48
    assert p.where((F.col("e") == "a") & F.col("v").isNull()).count() == 2
    assert P.duplicate_keys(p, ["e", "ts"]).count() == 0


def test_sequence_index_equals_row_number(spark):
    obs = _obs(spark)
    got = FE.sequence_index(obs, ["e"], "ts", "idx", block="5 hours").orderBy("e", "ts").collect()
    for e in ("a", "b"):
        idx = [r["idx"] for r in got if r["e"] == e]
        assert idx == list(range(1, len(idx) + 1))


def test_priority_union_and_semi(spark):
    a = spark.createDataFrame([(1, "p"), (2, "p")], "k int, s string")
    b = spark.createDataFrame([(2, "f"), (3, "f")], "k int, s string")
    u = sorted(tuple(r) for r in P.priority_union(a, b, ["k"]).collect())
    assert u == [(1, "p"), (2, "p"), (3, "f")]
    c = P.semi_count(b, a, ["k"]).first()
    assert (c["n_in"], c["n_out"]) == (1, 1)


def test_freq_table_null_row(spark):  # N14
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "c string")
    rows = {(r["value"], r["n"]) for r in D.freq_table(df, ["c"]).collect()}
    assert rows == {("x", 2), ("y", 1), (None, 0)}


def test_strict_mean(spark):  # N1
    df = spark.createDataFrame([("h", 1.0), ("h", None), ("g", 2.0)], "k string, x double")
    got = {r["k"]: r["x"] for r in D.spatial_mean(df, ["k"], strict=["x"]).collect()}
    assert got == {"h": None, "g": 2.0}


def test_acf_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=n).cumsum()
    x[[7, 50, 51, 200]] = np.nan
    rows = [(i + 1, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "idx long, x double")
    got = {r["lag"]: r["acf"] for r in S.acf(df, "idx", "x", max_lag=20, block=64).collect()}
    c = x - np.nanmean(x)
    g = []
    for lag in range(21):
        prod = c[: n - lag] * c[lag:]
        ok = ~np.isnan(prod)
        g.append(prod[ok].sum() / (ok.sum() + lag))
    for lag in range(21):
        assert abs(got[lag] - g[lag] / g[0]) < 1e-12


def test_pacf_ar1(spark):
    rho = 0.6
    acf = spark.createDataFrame([(k, rho ** k) for k in range(6)], "lag int, acf double")
    got = {r["lag"]: r["pacf"] for r in S.pacf(acf).collect()}
    assert abs(got[1] - 0.6) < 1e-12 and all(abs(got[k]) < 1e-12 for k in range(2, 6))


def test_global_rank(spark):
    vals = [float(v) for v in np.random.default_rng(3).normal(size=500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = sorted((r["rank"], r["x"]) for r in S.global_rank(df, "x", buckets=8).collect())
    assert [g[1] for g in got] == sorted(vals) and [g[0] for g in got] == list(range(1, 501))


def test_rolling_mean_rows(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, d), float(d)) for d in range(1, 8)], "k string, d date, x double")
    got = [r["r"] for r in S.rolling_mean(df, ["k"], "d", "x", k=3, out="r").orderBy("d").collect()]
    assert got[:2] == [None, None] and got[2] == 2.0 and got[6] == 6.0


def test_pivot_longer_split(spark):
    df = spark.createDataFrame([(True, 1.0, 2.0)], "f boolean, spf_humidity_mean double, spf_humidity_sd double")
    rows = {(r["variable"], r["statistic"]) for r in
            P.pivot_longer(df, ["f"], ["spf_humidity_mean", "spf_humidity_sd"], ("variable", "statistic"), "_").collect()}
    assert rows == {("spf_humidity", "mean"), ("spf_humidity", "sd")}
