"""Fits of any number of strata, and the model store."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kairos.operators import gram, store
from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel
from kairos.operators.report import score
from kairos.operators.strata import StratifiedOLS
from tests.test_models import _sim

SCHEMA = "g string, post double, x double, f string, t double, y double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_sim(seed=9), SCHEMA)


def test_hundred_thousand_strata(spark):
    """Every stratum's line is the one it was made from; scoring joins, nothing is collected."""
    n = 100_000
    df = spark.range(0, 6 * n, numPartitions=8).select(
        (F.col("id") % n).cast("string").alias("s"), (F.floor(F.col("id") / n) + F.col("id") % 7).cast("double").alias("x"))
    k = F.col("s").cast("double")
    df = df.withColumn("y", k / 1000 + (k % 11 - 5) * F.col("x") + F.when(F.col("x") % 2 == 0, 1e-3).otherwise(-1e-3))
    m = StratifiedOLS(df, ModelSpec("y", numeric=["x"], strata=["s"]))
    slope = m.coef.where("term = 'x'").select("stratum", "beta")
    off = slope.select(F.abs(F.col("beta") - (F.col("stratum").cast("double") % 11 - 5)).alias("d"))
    row = off.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).first()
    assert row["n"] == n and row["d"] < 2e-3
    got = m.score(df).agg(F.count("resid").alias("n"), F.max(F.abs("resid")).alias("d")).first()
    assert got["n"] == 6 * n and got["d"] < 3e-3
    assert m.fit.where("degenerate").count() == 0


def test_strata_equal_separate_fits(spark, frame):
    spec = ModelSpec("y", numeric=["x", "t"], flags=["post"], factors={"f": None}, strata=["g"])
    m = StratifiedOLS(frame, spec, "s")
    rows = frame.toPandas()
    coef = {(r.stratum, r.term): (r.beta, r.se) for r in m.coef.collect()}
    scored = m.score(frame).toPandas()
    for g, sub in rows.groupby("g"):
        X = np.column_stack([np.ones(len(sub)), sub["post"], sub["x"] - 1e5, sub["t"],
                             *[(sub["f"] == str(k)).astype(float) for k in (1, 2, 3)]])
        b, rss, *_ = np.linalg.lstsq(X, sub["y"].to_numpy(), rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / (len(sub) - 7))
        for j, t in enumerate(["post", "x", "t", "f1", "f2", "f3"], start=1):
            assert coef[g, t][0] == pytest.approx(b[j], abs=1e-7) and coef[g, t][1] == pytest.approx(se[j], rel=1e-6)
        got = scored[scored["g"] == g].sort_values("t")["fitted"].to_numpy()
        want = pd.Series(X @ b, index=sub["t"].to_numpy()).sort_index().to_numpy()
        assert np.allclose(got, want, atol=1e-7)


def test_degenerate_and_unfitted_strata(spark):
    df = spark.createDataFrame([("one", 1.0, 5.0, "u"), ("two", 1.0, 1.0, "u"), ("two", 2.0, 2.0, "v"), ("const", 3.0, 1.0, "u"),
                                ("const", 3.0, 2.0, "v"), ("const", 3.0, 4.0, "u"), (None, None, 1.0, "u")],
                               "s string, x double, y double, f string")
    m = StratifiedOLS(df, ModelSpec("y", numeric=["x"], strata=["s"]))
    fit = {r.stratum: r for r in m.fit.collect()}
    assert fit["one"].degenerate and fit["two"].degenerate and not fit["const"].degenerate
    terms = {(r.stratum, r.term) for r in m.coef.collect()}
    assert ("const", "x") not in terms and ("two", "x") in terms
    new = spark.createDataFrame([("const", 9.0, 0.0, "u"), ("never", 1.0, 0.0, "u")], df.schema)
    got = {r.s: r.fitted for r in m.score(new).collect()}
    assert got["const"] == pytest.approx(7 / 3) and got["never"] is None
    lv = StratifiedOLS(df, ModelSpec("y", factors={"f": ["u"]}, strata=["s"]))
    assert {r.f: r.fitted for r in lv.score(df.where("s = 'two'")).collect()}["v"] is None
    empty = StratifiedOLS(df.where("false"), ModelSpec("y", numeric=["x"], strata=["s"]))
    assert empty.coef.count() == 0 and empty.score(df).where("fitted IS NOT NULL").count() == 0


def test_both_gram_paths_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 200}", f"e{i % 3}", float(rng.normal()), str(i % 4), float(rng.normal())) for i in range(2000)]
    df = spark.createDataFrame(rows, "s string, g string, x double, f string, y double").repartition(3)
    design = gram.resolve_design(df, ModelSpec("y", numeric=["x"], factors={"f": None}, strata=["s"], group="g"))
    got = {(r["_stratum"], r["_entity"]): np.array(r["g"]) for r in gram.gram_table(df, design).collect()}
    pdf = gram.model_frame(df, design).toPandas()
    for key, sub in pdf.groupby(["_stratum", "_entity"]):
        A = np.column_stack([np.ones(len(sub)), sub["x__x"], *[(sub["f__f"] == k).astype(float) for k in (2, 3, 4)], sub["_y"]])
        assert np.allclose(got[key], (A.T @ A)[np.triu_indices(6)], atol=1e-9)
    assert len(got) == pdf.groupby(["_stratum", "_entity"]).ngroups


def test_wide_factor_is_refused(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("f"), F.rand(1).alias("y"))
    with pytest.raises(ValueError, match="levels"):
        gram.resolve_design(df, ModelSpec("y", factors={"f": None}))


@pytest.mark.parametrize("slopes", [[], ["post"]])
def test_store_round_trip(spark, frame, tmp_path, slopes):
    spec = ModelSpec("y", numeric=["x"], flags=[] if slopes else ["post"], slopes=slopes, factors={"f": None}, group="g")
    model = MixedModel(frame, spec, "m")
    kept = store.save(model, str(tmp_path / "m"), "k")
    read = store.load(spark, kept.path)
    assert (read.key, read.name, read.design.terms) == ("k", "m", model.design.terms)
    for over in ({}, {"post": 0.0}):
        a = score(frame, model, over).select("g", "t", "fitted").toPandas().sort_values(["g", "t"])["fitted"]
        b = score(frame, read, over).select("g", "t", "fitted").toPandas().sort_values(["g", "t"])["fitted"]
        assert np.allclose(a, b, atol=1e-9)
    assert read.fit.first()["loglik"] == model.fit.first()["loglik"]
    unseen = score(frame.withColumn("f", F.lit("zz")), read).where("fitted IS NOT NULL").count()
    assert unseen == 0


def test_refit_only_when_rows_or_specification_differ(spark, frame, tmp_path, monkeypatch):
    fits = []

    class Counted(MixedModel):
        def __init__(self, *a, **k):
            fits.append(1)
            super().__init__(*a, **k)

    monkeypatch.setattr(store, "MixedModel", Counted)
    spec = ModelSpec("y", numeric=["x"], flags=["post"], group="g")
    root = str(tmp_path)
    first = store.fitted(frame, spec, "m", root)
    again = store.fitted(frame.repartition(3).withColumn("other", F.lit(1)), spec, "m", root)
    assert len(fits) == 1 and again.path == first.path
    store.fitted(frame.withColumn("y", F.col("y") + 1), spec, "m", root)
    store.fitted(frame, ModelSpec("y", numeric=["x"], flags=["post"], group="g", method="REML"), "m", root)
    store.fitted(frame.where("t > 0"), spec, "m", root)
    assert len(fits) == 4
    assert not store.exists(spark, str(tmp_path / "none"))
