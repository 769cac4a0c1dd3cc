"""Random-effect blocks of any width: derivatives, optimum and job count against dense likelihoods."""

import math

import numpy as np
import pytest

from kairos.operators import newton
from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel, correction, lower, lr_test, profile
from tests.test_models import _dense, _sim

SCHEMA = "g string, post double, x double, f string, t double, y double"


@pytest.mark.parametrize("method", ["ML", "REML"])
@pytest.mark.parametrize("q", [1, 2, 3, 4])
def test_derivatives_against_differences(q, method):
    rng = np.random.default_rng(q)
    m = q + 3
    grams = []
    for _ in range(12):
        A = np.column_stack([np.ones(30), rng.normal(size=(30, m - 1))])
        A[:, -1] += A[:, :q] @ rng.normal(size=q)
        grams.append(A.T @ A)
    G = np.stack(grams)
    total, keep, k = G.sum(axis=0), list(range(m - 1)), q * (q + 1) // 2
    x = rng.normal(size=k) * 0.5

    def at(x):
        return newton.score_and_hessian(newton.entity_sums(G, lower(x, q)), total, lower(x, q), keep, method)

    def exact(x):
        L = lower(x, q)
        C = sum(correction(a, L)[0] for a in G)
        return profile(total - C, total[0, 0], sum(correction(a, L)[1] for a in G), keep, method)["loglik"]

    ll, grad, hess, _ = at(x)
    assert ll - at(1.3 * x)[0] == pytest.approx(exact(x) - exact(1.3 * x), abs=1e-9)
    step = 1e-5 * np.eye(k)
    assert np.allclose(grad, [(exact(x + e) - exact(x - e)) / 2e-5 for e in step], atol=1e-4, rtol=1e-5)
    assert np.allclose(hess, [(at(x + e)[1] - at(x - e)[1]) / 2e-5 for e in step], atol=1e-4, rtol=1e-5)


@pytest.mark.parametrize("method", ["ML", "REML"])
def test_two_slopes(spark, method):
    """Intercept and two slopes: the dense optimum, in at most six passes over the Gram table."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(25):
        b = rng.normal(size=3) * [2.0, 1.0, 0.5]
        for i in range(40):
            post, t = float(i > 20), (i - 20) / 10
            rows.append((f"g{g}", post, 1e5 + float(rng.normal()), str(i % 3), t,
                         float(5 + b[0] + (b[1] - 2) * post + b[2] * t + rng.normal())))
    df = spark.createDataFrame(rows, SCHEMA)
    m = MixedModel(df, ModelSpec("y", numeric=["x"], slopes=["post", "t"], factors={"f": ["0", "1", "2"]}, group="g",
                                 method=method))
    fit = m.fits["all"]
    assert m.jobs <= 6 and m.converged["all"]

    def dense(params):
        return _dense(rows, lambda r: [1.0, r[1], r[4], r[2] - 1e5, float(r[3] == "1"), float(r[3] == "2")], 3,
                      lower(params, 3), method)

    beta, ll = dense(fit.params)
    assert fit.res["loglik"] == pytest.approx(ll, abs=1e-6)
    got = m.coefficients()["all"]
    assert [got[t][0] for t in ("post", "t", "f1", "f2")] == pytest.approx([beta[1], beta[2], beta[4], beta[5]], abs=1e-7)
    for k in range(6):
        for sign in (-1, 1):
            e = np.zeros(6)
            e[k] = sign * 1e-3
            assert dense(fit.params + e)[1] < ll + 1e-9
    blups = {(r.entity, r.term): r.blup for r in m.ranef.collect()}
    assert len(blups) == 75
    # the posterior means, densely
    L, sub = lower(fit.params, 3), [r for r in rows if r[0] == "g7"]
    Z = np.array([[1.0, r[1], r[4]] for r in sub])
    res = np.array([r[5] - np.dot(beta, [1.0, r[1], r[4], r[2] - 1e5, r[3] == "1", r[3] == "2"]) for r in sub])
    want = L @ L.T @ Z.T @ np.linalg.solve(np.eye(40) + Z @ L @ L.T @ Z.T, res)
    assert [blups["g7", t] for t in ("(Intercept)", "post", "t")] == pytest.approx(list(want), abs=1e-6)


def test_slope_without_variance_ends_on_the_boundary(spark):
    rng = np.random.default_rng(8)
    rows = [(f"g{g}", float(i % 2), 0.0, "0", 0.0, float(3.0 * g + 2.0 * (i % 2) + rng.normal())) for g in range(6) for i in range(60)]
    m = MixedModel(spark.createDataFrame(rows, SCHEMA), ModelSpec("y", slopes=["post"], group="g"))
    ri = MixedModel(spark.createDataFrame(rows, SCHEMA), ModelSpec("y", flags=["post"], group="g"))
    assert m.converged["all"] and m.fits["all"].res["loglik"] >= ri.fits["all"].res["loglik"] - 1e-8
    assert all(math.isfinite(x) for x in m.fits["all"].params)


def test_strata_and_one_entity(spark):
    """Strata are searched side by side; a stratum with few entities still ends."""
    rows = _sim(seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    m = MixedModel(df, ModelSpec("y", numeric=["x"], slopes=["post"], group="g", strata=["f"]), strict=False)
    for s, fit in m.fits.items():
        alone = MixedModel(df.where(f"f = '{s}'"), ModelSpec("y", numeric=["x"], slopes=["post"], group="g"), strict=False)
        assert fit.res["loglik"] == pytest.approx(alone.fits["all"].res["loglik"], abs=1e-6)


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 10])
def test_likelihood_ratio_at_any_df(df):
    """Upper tail of chi-square against numerical integration of its density."""
    for stat in (0.1, 1.0, 5.0, 30.0):
        x = np.linspace(0.0, 1.0, 400_001)[1:-1]
        v = stat + x / (1 - x)                      # from stat to infinity
        f = v ** (df / 2 - 1) * np.exp(-v / 2) / (2 ** (df / 2) * math.gamma(df / 2)) / (1 - x) ** 2
        assert lr_test(0.0, stat / 2, df)[1] == pytest.approx(np.trapezoid(f, x), rel=1e-4, abs=1e-12)
    assert lr_test(1.0, 0.5, df) == (0.0, 1.0)
