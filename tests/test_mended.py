"""Cases that once lost, cut or re-labelled rows without a word."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairos.functions.text import pad_left
from kairos.operators import describe as D
from kairos.operators import features as FE
from kairos.operators import panel as P
from kairos.operators import series as S
from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel
from kairos.operators.quantiles import exact_quantiles, global_quantiles
from kairos.operators.report import score


@pytest.mark.parametrize("origin", [1, -600, 12345])
def test_acf_is_the_same_from_any_origin(spark, origin):
    x = np.sin(np.arange(400.0)) + np.arange(400) % 7
    df = spark.createDataFrame([(origin + i, float(v)) for i, v in enumerate(x)], "idx long, x double")
    got = {r.lag: (r.acf, r.n_pairs) for r in S.acf(df, "idx", "x", max_lag=10, block=16).collect()}
    c = x - x.mean()
    g = [float((c[:400 - k] * c[k:]).sum()) / 400 for k in range(11)]
    assert all(got[k][1] == 400 - k and abs(got[k][0] - g[k] / g[0]) < 1e-10 for k in range(11))


def test_sequence_index_keeps_rows_without_order_or_key(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h)) for h in (1, 30, 100)] + [("a", None), (None, t0), (None, None)]
    got = FE.sequence_index(spark.createDataFrame(rows, "e string, ts timestamp_ntz"), ["e"], "ts", "i", "1 day")
    assert sorted(((r.e or "", r.ts is None, r.i) for r in got.collect())) == [
        ("", False, 1), ("", True, 2), ("a", False, 1), ("a", False, 2), ("a", False, 3), ("a", True, 4)]


def _levels(spark):
    rng = np.random.default_rng(2)
    rows = [("abc"[i % 3], f"g{i % 4}", float(rng.normal() + 2 * (i % 3 == 1) + 9 * (i % 3 == 2))) for i in range(300)]
    return spark.createDataFrame([*rows, (None, "g1", 1.0)], "f string, g string, y double")


def test_unlisted_and_null_levels_are_missing(spark):
    df = _levels(spark)
    m = MixedModel(df, ModelSpec("y", factors={"f": ["a", "b"]}), "ols")
    only = MixedModel(df.where("f in ('a', 'b')"), ModelSpec("y", factors={"f": ["a", "b"]}), "ols")
    assert m.fit.first().n == 200
    assert m.coefficients()["all"]["fb"][0] == pytest.approx(only.coefficients()["all"]["fb"][0])
    fitted = score(df, m).groupBy("f").agg(F.count("fitted").alias("n")).collect()
    assert {r.f: r.n for r in fitted} == {"a": 100, "b": 100, "c": 0, None: 0}


def test_histogram_ignores_nan_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([("p", 0.0), ("p", 10.0), ("q", 0.4), ("q", float("nan")), ("q", None)],
                               "g string, v double")
    h = D.histogram(df, "v", bins=5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 0, 0, 0, 1] and h[0].x_min == -1.25
    by = D.histogram(df, "v", bins=5, by=["g"])
    assert by.count() == 10 and by.agg(F.sum("n")).first()[0] == 3
    none = D.histogram(df.where("v > 99 and not isnan(v)"), "v", by=["g"])
    assert none.count() == 0 and none.columns == ["g", "bin", "x_min", "x_max", "n"]


def test_variance_ratio_beyond_the_first_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{g}", 1e5 * g + float(rng.normal() * 1e-3)) for g in range(8) for _ in range(10)]
    df = spark.createDataFrame(rows, "g string, y double")
    m = MixedModel(df, ModelSpec("y", group="g"), "far")
    assert m.fits["all"].params[0] > 1e3 and m.fit.first().converged
    with pytest.raises(RuntimeError, match="converge"):
        MixedModel(df, ModelSpec("y", group="g"), "far", max_expand=0)
    assert not MixedModel(df, ModelSpec("y", group="g"), "far", max_expand=0, strict=False).fit.first().converged


def test_degenerate_stratum_is_flagged_and_others_fit(spark):
    rng = np.random.default_rng(5)
    rows = [("exact", float(i), 2.0 * i + 1) for i in range(20)] + [("one", 1.0, 5.0)]
    rows += [("noisy", float(i), 2.0 * i + float(rng.normal())) for i in range(50)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    fit = {r.stratum: r for r in MixedModel(df, ModelSpec("y", numeric=["x"], strata=["s"]), "ols").fit.collect()}
    assert fit["exact"].degenerate and fit["one"].degenerate and not fit["noisy"].degenerate
    assert math.isfinite(fit["noisy"].loglik)


def test_keys_are_padded_not_cut(spark):
    df = spark.createDataFrame([("7",), ("12345",), (None,)], "k string")
    assert [r[0] for r in df.select(pad_left("k", 4)).collect()] == ["0007", "12345", None]


def test_priority_union_matches_null_keys(spark):
    a = spark.createDataFrame([(None, "p"), (1, "p")], "k int, s string")
    b = spark.createDataFrame([(None, "f"), (2, "f"), (2, "f")], "k int, s string")
    assert sorted(map(str, P.priority_union(a, b, ["k"]).collect())) == sorted(
        map(str, [*a.collect(), *b.where("k = 2").collect()]))


def test_exact_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(6)
    rows = [("hot" if i % 3 else f"g{i % 9}", float(rng.integers(0, 40))) for i in range(900)]
    rows += [("one", 3.0), (None, 1.0), (None, 2.0), ("nan", float("nan")), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r["_q"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    want = df.where("v is not null and not isnan(v)").groupBy("g").agg(F.percentile("v", probs).alias("q")).collect()
    assert got == {r.g: pytest.approx(r.q) for r in want}
    assert global_quantiles(df.where("g = 'null'"), "v", [0.5]) is None
    assert global_quantiles(df, "v", [0.5])[0] == pytest.approx(
        float(np.median([r[1] for r in rows if r[1] is not None and not math.isnan(r[1])])))


def test_prepost_leaves_out_rows_without_period(spark):
    df = spark.createDataFrame([(True, 1.0), (False, 2.0), (None, 9.0)], "f boolean, v double")
    assert D.prepost_summary(df, "f", ["v"]).count() == 2
    assert D.prepost_summary(df, "f", ["v"], keep_null_period=True).count() == 3
