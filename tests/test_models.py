"""Gram/profile mixed models against dense GLS on simulated panels."""

import math

import numpy as np
import pytest

from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel, correction, lower, profile, unpack
from kairos.operators.report import het_test


def _sim(seed=0, groups=6, n_per=(150, 220, 90, 300, 180, 120), effect=-3.0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        b0 = rng.normal(scale=2.0)
        b1 = rng.normal(scale=0.7)
        for i in range(n_per[g]):
            post = 1.0 if i > n_per[g] // 2 else 0.0
            x = rng.normal(loc=1e5, scale=300.0)  # badly scaled covariate
            f = int(rng.integers(0, 4))
            y = 10 + b0 + (effect + b1) * post + 0.002 * (x - 1e5) + [0, 1.5, -0.5, 2.0][f] + rng.normal()
            rows.append((f"g{g}", post, x, str(f), float(i), y))
    return rows


def _dense(rows, terms_fn, q, L, method):
    groups = sorted({r[0] for r in rows})
    XtVX, XtVy, yVy, ld, N = 0, 0, 0, 0.0, 0
    for g in groups:
        sub = [r for r in rows if r[0] == g]
        X = np.array([terms_fn(r) for r in sub])
        y = np.array([r[5] for r in sub])
        V = np.eye(len(sub)) + X[:, :q] @ L @ L.T @ X[:, :q].T if q else np.eye(len(sub))
        Vi = np.linalg.inv(V)
        XtVX = XtVX + X.T @ Vi @ X
        XtVy = XtVy + X.T @ Vi @ y
        yVy = yVy + y @ Vi @ y
        ld += np.linalg.slogdet(V)[1]
        N += len(sub)
    beta = np.linalg.solve(XtVX, XtVy)
    rss = yVy - beta @ XtVy
    p = len(beta)
    if method == "ML":
        ll = -N / 2 * (math.log(2 * math.pi * rss / N) + 1) - ld / 2
    else:
        ll = -(N - p) / 2 * (math.log(2 * math.pi * rss / (N - p)) + 1) - ld / 2 - np.linalg.slogdet(XtVX)[1] / 2
    return beta, ll


def _terms(r):
    return [1.0, r[1], r[2], *[1.0 if r[3] == str(k) else 0.0 for k in (1, 2, 3)]]


@pytest.mark.parametrize("method", ["ML", "REML"])
def test_random_intercept_matches_dense(spark, method):
    rows = _sim()
    df = spark.createDataFrame(rows, "g string, post double, x double, f string, t double, y double")
    m = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}, group="g", method=method))
    fit = m.fits["all"]
    beta_d, ll_d = _dense(rows, _terms, 1, lower(fit.params, 1), method)
    coefs = m.coefficients()["all"]
    names = ["(Intercept)", "post", "x", "f1", "f2", "f3"]
    for i, n in enumerate(names):
        assert abs(coefs[n][0] - beta_d[i]) < 1e-6 * max(1, abs(beta_d[i]))
    assert abs(fit.res["loglik"] - ll_d) < 1e-6
    # optimum: no better θ nearby on the dense criterion
    for f in (0.9, 1.1):
        _, ll2 = _dense(rows, _terms, 1, lower(fit.params * f, 1), method)
        assert ll2 <= ll_d + 1e-6
    assert abs(coefs["post"][0] + 3.0) < 0.5


def test_random_slope_improves_loglik(spark):
    rows = _sim(seed=2)
    df = spark.createDataFrame(rows, "g string, post double, x double, f string, t double, y double")
    ri = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}, group="g"))
    ris = MixedModel(df, ModelSpec("y", numeric=["x"], slopes=["post"], factors={"f": None}, group="g"))
    assert ris.fits["all"].res["loglik"] >= ri.fits["all"].res["loglik"] - 1e-9
    L = lower(ris.fits["all"].params, 2)
    _, ll_d = _dense(rows, _terms, 2, L, "ML")
    assert abs(ris.fits["all"].res["loglik"] - ll_d) < 1e-6
    assert ris.ranef.count() == 12


def test_ols_matches_lstsq_and_shuffle_invariance(spark):
    rows = _sim(seed=4)
    df = spark.createDataFrame(rows, "g string, post double, x double, f string, t double, y double")
    m = MixedModel(df.repartition(7), ModelSpec("y", numeric=["x", "t"], flags=["post"]))
    X = np.array([[1.0, r[1], r[2], r[4]] for r in rows])
    y = np.array([r[5] for r in rows])
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    got = m.coefficients()["all"]
    for i, n in enumerate(["(Intercept)", "post", "x", "t"]):
        assert abs(got[n][0] - b[i]) < 1e-7 * max(1, abs(b[i]))


def test_strata_drop_aliased_columns(spark):
    rows = _sim(seed=5)
    df = spark.createDataFrame(rows, "g string, post double, x double, f string, t double, y double")
    m = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}, group="g", strata=["f"]))
    assert set(m.fits) == {"0", "1", "2", "3"}
    for s, c in m.coefficients().items():
        assert not any(t.startswith("f") for t in c)  # factor aliased with the intercept in each stratum
        assert "post" in c


def test_correction_q1_closed_form():
    rng = np.random.default_rng(0)
    A = np.column_stack([np.ones(20), rng.normal(size=(20, 3))])
    G = A.T @ A
    theta = 0.7
    C, ld = correction(G, np.array([[math.sqrt(theta)]]))
    s = G[0]
    assert np.allclose(C, theta / (1 + 20 * theta) * np.outer(s, s))
    assert abs(ld - math.log(1 + 20 * theta)) < 1e-12
    assert np.allclose(unpack(G[np.triu_indices(4)], 4), G)


def test_het_test_values(spark):
    eff = spark.createDataFrame([("a", -3.0, 0.2), ("b", -2.0, 0.3)], "stratum string, beta double, se double")
    r = het_test(eff).first()
    z = (-3.0 + 2.0) / math.sqrt(0.04 + 0.09)
    assert abs(r["wald"] - z) < 1e-12
    assert abs(r["p_wald"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    w1, w2 = 1 / 0.04, 1 / 0.09
    pooled = (-3.0 * w1 - 2.0 * w2) / (w1 + w2)
    q = (-3.0 - pooled) ** 2 * w1 + (-2.0 - pooled) ** 2 * w2
    assert abs(r["pooled_beta"] - pooled) < 1e-12 and abs(r["cochran"] - q) < 1e-9
    assert abs(r["p_cochran"] - math.erfc(math.sqrt(q / 2))) < 1e-12


def test_profile_reml_term():
    rng = np.random.default_rng(1)
    A = np.column_stack([np.ones(50), rng.normal(size=(50, 2)), rng.normal(size=50)])
    M = A.T @ A
    r = profile(M, 50.0, 0.0, [0, 1, 2], "REML")
    assert r["p"] == 3 and r["rss"] > 0


def test_shared_gram_gives_same_fits(spark):
    rows = _sim(seed=7)
    df = spark.createDataFrame(rows, "g string, post double, x double, f string, t double, y double")
    ri = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}, group="g"))
    fe_shared = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}), share=ri)
    fe = MixedModel(df, ModelSpec("y", numeric=["x"], flags=["post"], factors={"f": None}))
    a, b = fe_shared.coefficients()["all"], fe.coefficients()["all"]
    assert all(abs(a[t][0] - b[t][0]) < 1e-9 and abs(a[t][1] - b[t][1]) < 1e-9 for t in b)
    ris = MixedModel(df, ModelSpec("y", numeric=["x"], slopes=["post"], factors={"f": None}, group="g"), share=ri)
    assert ris.fits["all"].res["loglik"] >= ri.fits["all"].res["loglik"] - 1e-9
