"""Penalised trend smoother (W10): cubic B-splines, a difference penalty, smoothness by cross-validation.

One Gram pass over the basis gives BᵀB, Bᵀy and yᵀy per stratum; tasks solve
(BᵀB + λDᵀD) a = Bᵀy for a list of λ and keep the one of least generalised cross-validation

    n·rss / (n − edf)²,   edf = tr((BᵀB + λDᵀD)⁻¹ BᵀB)

(ties: the smaller λ).  Rows are never gathered, and strata never reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.functions.spline import bspline_basis, bspline_parts, bspline_place
from kairos.operators.gram import ModelSpec, gram_table, resolve_design
from kairos.operators.newton import symmetric
from kairos.operators.panel import join_groups
from kairos.operators.strata import stratum_key
from kairos.session import materialize

#: Penalties tried: thirds of a power of ten from 1e-4 to 1e6.
PENALTIES = tuple(10.0 ** (i / 3.0) for i in range(-12, 19))
PARTS = tuple(f"_part{k}" for k in range(4))
_FIT = "stratum string, n long, penalty double, edf double, gcv double, coefs array<double>"


def difference_penalty(size: int, order: int = 2) -> np.ndarray:
    D = np.diff(np.eye(size), n=order, axis=0)
    return D.T @ D


def choose(G: np.ndarray, penalties=PENALTIES, order: int = 2) -> tuple[float, float, float, np.ndarray] | None:
    """(penalty, edf, gcv, coefficients) from the Gram of [B y]; None without rows."""
    B, b, yy = G[:-1, :-1], G[:-1, -1], float(G[-1, -1])
    n = float(B.sum())          # the basis adds up to one in every row
    if n < 0.5:
        return None
    P, best = difference_penalty(len(b), order), None
    for lam in penalties:
        A = B + lam * P
        try:
            inv = np.linalg.inv(A)
        except np.linalg.LinAlgError:
            inv = np.linalg.pinv(A, hermitian=True)
        if not np.isfinite(inv).all() or np.abs(A @ inv @ b - b).max() > 1e-6 * max(1.0, np.abs(b).max()):
            inv = np.linalg.pinv(A, hermitian=True)     # too few places for the columns
        a = inv @ b
        edf = float(np.sum(inv * B))
        rss = max(yy - float(a @ b) - lam * float(a @ P @ a), 0.0)
        gcv = n * rss / (n - edf) ** 2 if n - edf > 1e-6 else math.inf
        if best is None or gcv < best[2]:
            best = lam, edf, gcv, a
    return best


class PenalisedTrend:
    """Smooth trend of ``outcome`` over ``x`` in every stratum; ``fit`` is a DataFrame of one row per stratum."""

    def __init__(self, df: DataFrame, outcome: str, x: str, low: float, high: float, strata=(), intervals: int = 20,
                 penalties=PENALTIES, order: int = 2):
        self.outcome, self.x, self.bounds, self.intervals = outcome, x, (float(low), float(high)), intervals
        self.names = [f"_bs{j}" for j in range(intervals + 3)]
        self.spec = ModelSpec(outcome, flags=self.names, strata=list(strata), scale=False)
        placed = self._placed(df)
        with_basis = placed.withColumns(dict(zip(self.names, bspline_basis("_cell", PARTS, intervals))))
        gram = gram_table(with_basis, resolve_design(with_basis, self.spec))
        m = len(self.names) + 2

        def solve(batches):
            for pdf in batches:
                rows = []
                for s, G in zip(pdf["_stratum"], symmetric(np.stack(pdf["g"].to_numpy()), m) if len(pdf) else ()):
                    got = choose(G[1:, 1:], penalties, order)
                    if got:
                        rows.append((s, int(round(G[0, 0])), got[0], got[1], got[2], [float(v) for v in got[3]]))
                yield pd.DataFrame(rows, columns=["stratum", "n", "penalty", "edf", "gcv", "coefs"])

        self.fit = materialize(gram.select("_stratum", "g").mapInPandas(solve, _FIT))

    def _placed(self, df: DataFrame) -> DataFrame:
        cell, share = bspline_place(self.x, *self.bounds, self.intervals)
        return df.withColumns({"_cell": cell, "_share": share}).withColumns(
            dict(zip(PARTS, bspline_parts(F.col("_share"))))).drop("_share")

    def score(self, df: DataFrame, trend: str = "trend", penalty: str | None = None) -> DataFrame:
        """``df`` with the trend at every x (rows without an outcome too); null where x is null or beyond the
        bounds, or the stratum has no fit."""
        wide = self.fit.select(F.col("stratum").alias("_stratum"), F.col("coefs").alias("_coefs"),
                               F.col("penalty").alias("_penalty"))
        d = join_groups(self._placed(df).withColumn("_stratum", stratum_key(self.spec)), wide, ["_stratum"])
        value = None
        for k, part in enumerate(PARTS):
            term = F.element_at("_coefs", F.col("_cell") + (k + 1)) * F.col(part)
            value = term if value is None else value + term
        d = d.withColumn(trend, value)
        if penalty:
            d = d.withColumn(penalty, F.col("_penalty"))
        return d.drop("_stratum", "_coefs", "_penalty", "_cell", *PARTS)
