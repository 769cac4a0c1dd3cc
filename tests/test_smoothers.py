"""B-spline and natural spline bases, the penalised smoother, distribution tails."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairos.functions.spline import (bspline_basis, bspline_parts, bspline_place, natural_basis,
                                     natural_pieces, natural_spline_basis)
from kairos.functions.tails import chi2_upper_tail, erfc, normal_upper_tail
from kairos.operators.smoother import PenalisedTrend, choose, difference_penalty


def _bspline(x, t, i, k):
    """Cox–de Boor recursion on values; the last knot belongs to the last interval."""
    if k == 1:
        return float(t[i] <= x < t[i + 1] or (x == t[-1] and t[i] < t[i + 1] == t[-1]))
    a = (x - t[i]) / (t[i + k - 1] - t[i]) * _bspline(x, t, i, k - 1) if t[i + k - 1] > t[i] else 0.0
    b = (t[i + k] - x) / (t[i + k] - t[i + 1]) * _bspline(x, t, i + 1, k - 1) if t[i + k] > t[i + 1] else 0.0
    return a + b


def _frame(spark, xs):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in xs], "x double")


def test_equal_interval_basis(spark):
    xs = [0.0, 0.3, 1.0, 2.49, 2.5, 7.2, 10.0, None, -0.1, 10.1]
    cell, share = bspline_place("x", 0.0, 10.0, 4)
    df = _frame(spark, xs).withColumns({"c": cell, "u": share}).withColumns(
        {f"p{k}": p for k, p in enumerate(bspline_parts(F.col("u")))})
    rows = df.select("x", *[b.alias(f"b{j}") for j, b in enumerate(bspline_basis("c", ["p0", "p1", "p2", "p3"], 4))]).collect()
    t = [2.5 * (j - 3) for j in range(11)]
    for r in rows:
        if r["x"] is None or not 0 <= r["x"] <= 10:
            assert all(v is None for v in r[1:])
        else:
            at = r["x"] if r["x"] < 10 else 10 - 1e-12
            assert np.allclose(r[1:], [_bspline(at, t, i, 4) for i in range(7)], atol=1e-9) and sum(r[1:]) == pytest.approx(1)


@pytest.mark.parametrize("knots", [[0.0, 1.0], [0.0, 0.7, 1.0], [-2.0, 0.1, 0.4, 5.0], [1.0, 2.0, 4.0, 8.0, 16.0]])
def test_natural_basis(spark, knots):
    xs = [knots[0] + (knots[-1] - knots[0]) * v for v in np.linspace(-0.4, 1.4, 61)]
    df = _frame(spark, xs)
    ours = np.array(df.select(*natural_basis("x", knots).values()).collect())
    k, poly = natural_pieces(knots)
    assert ours.shape[1] == len(knots) - 1 == poly.shape[1]
    # inside: the B-splines without the first, through the complement of the boundary curvatures
    t = [knots[0]] * 3 + list(knots) + [knots[-1]] * 3
    inside = [i for i, x in enumerate(xs) if knots[0] <= x <= knots[-1]]
    B = np.array([[_bspline(xs[i], t, j, 4) for j in range(1, len(t) - 4)] for i in inside])
    Q = np.linalg.lstsq(B, ours[inside], rcond=None)[0]
    assert np.allclose(B @ Q, ours[inside], atol=1e-9) and np.allclose(Q.T @ Q, np.eye(len(knots) - 1), atol=1e-9)
    # beyond the knots: straight lines that go on with the slope at the knot
    for edge in (slice(0, 13), slice(-13, None)):
        assert np.allclose(np.diff(ours[edge], n=2, axis=0), 0.0, atol=1e-9)
    # the same space as the truncated powers, with an intercept
    if len(knots) > 2:
        other = np.array(df.select(*natural_spline_basis("x", knots).values()).collect())
        both = np.column_stack([np.ones(len(xs)), ours])
        fit = both @ np.linalg.lstsq(both, other, rcond=None)[0]
        assert np.allclose(fit, other, atol=1e-6 * np.abs(other).max())
    with pytest.raises(ValueError):
        natural_basis("x", [1.0, 1.0])


def test_penalty_is_chosen_by_cross_validation():
    """Leave-one-out by hand has its GCV form minimised: the score of every penalty, densely."""
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 10, 120))
    y = np.sin(x) + rng.normal(scale=0.3, size=120)
    t = [2.0 * (j - 3) for j in range(12)]
    B = np.array([[_bspline(v, t, j, 4) for j in range(8)] for v in x])
    A = np.column_stack([B, y])
    penalties = [10.0 ** k for k in range(-4, 7)]
    lam, edf, gcv, a = choose(A.T @ A, penalties)
    scores = []
    for p in penalties:
        S = B @ np.linalg.solve(B.T @ B + p * difference_penalty(8), B.T)
        scores.append(120 * np.sum((y - S @ y) ** 2) / (120 - np.trace(S)) ** 2)
    assert lam == penalties[int(np.argmin(scores))] and gcv == pytest.approx(min(scores), rel=1e-8)
    assert np.sqrt(np.mean((B @ a - np.sin(x)) ** 2)) < 0.12 and 3 < edf < 8


def test_trend_per_stratum(spark):
    rng = np.random.default_rng(4)
    rows = [(s, float(i), float(np.sin(i / 15) * k + rng.normal(scale=0.1)) if i % 7 else None)
            for s, k in (("wave", 3.0), ("flat", 0.0)) for i in range(200)]
    rows += [("two", 1.0, 5.0), ("two", 9.0, 6.0), ("none", 3.0, None), (None, 3.0, 1.0), ("wave", None, 2.0), ("wave", 500.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    m = PenalisedTrend(df, "y", "x", 0, 199, strata=["s"], intervals=12)
    fit = {r.stratum: r for r in m.fit.collect()}
    assert set(fit) == {"wave", "flat", "two"}
    assert fit["wave"].edf > 6 > 3 > fit["flat"].edf and fit["wave"].penalty < fit["flat"].penalty
    got = m.score(df)
    assert got.columns == [*df.columns, "trend"] and got.count() == len(rows)
    by = {(r.s, r.x): r.trend for r in got.collect()}
    assert max(abs(by["wave", float(i)] - 3 * math.sin(i / 15)) for i in range(200)) < 0.2
    assert by["wave", 500.0] is None and by["none", 3.0] is None and by["wave", None] is None
    empty = PenalisedTrend(df.where("false"), "y", "x", 0, 199, strata=["s"])
    assert empty.fit.count() == 0


def test_tails(spark):
    zs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 1.999999, 2.0, 2.000001, 3.0, 5.0, 10.0, 25.0, -0.3, -4.0, None, math.nan]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", erfc("z").alias("e"), normal_upper_tail("z").alias("n"), chi2_upper_tail("z", 1).alias("c1"),
                       chi2_upper_tail("z", 2).alias("c2"), chi2_upper_tail("z", 5).alias("c5"),
                       chi2_upper_tail("z", 6).alias("c6")).collect():
        if r.z is None:
            assert list(r[1:]) == [None] * 6
        elif math.isnan(r.z):
            assert all(math.isnan(v) for v in r[1:])
        else:
            assert r.e == pytest.approx(math.erfc(r.z), rel=1e-12) and r.n == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-12)
            h = max(r.z, 0.0) / 2
            assert r.c1 == pytest.approx(math.erfc(math.sqrt(h)), rel=1e-12) and r.c2 == pytest.approx(math.exp(-h), rel=1e-12)
            assert r.c6 == pytest.approx(math.exp(-h) * (1 + h + h * h / 2), rel=1e-12)
            assert r.c5 == pytest.approx(math.erfc(math.sqrt(h)) + math.exp(-h) * math.sqrt(h / math.pi) * (2 + 4 * h / 3), rel=1e-11)
    with pytest.raises(ValueError):
        chi2_upper_tail("z", 0)
