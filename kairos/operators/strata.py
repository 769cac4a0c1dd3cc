"""Least squares in any number of strata (M1, M5): nothing per stratum reaches the driver.

The Gram table has one row per stratum; tasks solve their rows, and coefficients, fit statistics and
the wide row that scoring joins to are DataFrames.  Strata may be entities: their number only sets the
length of those tables.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.operators.gram import INTERCEPT, ModelSpec, gram_table, resolve_design
from kairos.operators.mixed import LOG2PI, aliased_mask
from kairos.operators.newton import symmetric
from kairos.operators.panel import join_groups
from kairos.session import materialize

_SOLVED = ("stratum string, n long, p int, rss double, sigma2 double, loglik double, degenerate boolean, "
           "beta array<double>, se array<double>")


def stratum_key(spec: ModelSpec) -> F.Column:
    return F.concat_ws("|", *[F.col(s).cast("string") for s in spec.strata]) if spec.strata else F.lit("all")


class StratifiedOLS:
    """One least-squares fit per stratum of ``spec`` (no random effects).

    Columns that are constant or aliased in a stratum get no coefficient there; a stratum with no more rows
    than columns, or fitted exactly, has coefficients and is ``degenerate``: no variance, no standard errors."""

    def __init__(self, df: DataFrame, spec: ModelSpec, name: str = "model"):
        if spec.group is not None:
            raise ValueError("strata with random effects are fitted by MixedModel")
        self.spec, self.name = spec, name
        self.design = resolve_design(df, spec)
        self.terms = self.design.terms
        self.gram = gram_table(df, self.design)
        self.solved = materialize(self.gram.select("_stratum", "g").mapInPandas(self._solver(), _SOLVED))

    def _solver(self):
        terms, moments = list(self.terms), dict(self.design.moments)
        m = len(terms) + 1
        unscale = np.eye(m - 1)      # coefficients of centred and scaled columns → those of the columns
        for j, t in enumerate(terms):
            if t in moments:
                mu, sd = moments[t]
                unscale[j, j], unscale[0, j] = 1.0 / sd, -mu / sd

        def solve(batches):
            for pdf in batches:
                rows = []
                if pdf.empty:
                    continue
                grams = symmetric(np.stack(pdf["g"].to_numpy()), m)
                for s, G in zip(pdf["_stratum"], grams):
                    keep = aliased_mask(G[:-1, :-1])
                    n, p = G[0, 0], len(keep)
                    inv = np.linalg.inv(G[np.ix_(keep, keep)])
                    b = inv @ G[keep, -1]
                    rss = float(G[-1, -1] - b @ G[keep, -1])
                    bad = n <= p or rss <= 1e-12 * max(1.0, float(G[-1, -1]))
                    sigma2 = math.nan if bad else rss / (n - p)
                    T = unscale[np.ix_(keep, keep)]
                    beta, se = [None] * (m - 1), [None] * (m - 1)
                    cov = sigma2 * (T @ inv @ T.T)
                    for j, x, v in zip(keep, T @ b, np.diag(cov)):
                        beta[j], se[j] = float(x), float(math.sqrt(max(v, 0.0))) if not bad else math.nan
                    ll = math.nan if bad else -n / 2 * (LOG2PI + math.log(rss / n) + 1)
                    rows.append((s, int(n), p, max(rss, 0.0), sigma2, ll, bad, beta, se))
                yield pd.DataFrame(rows, columns=["stratum", "n", "p", "rss", "sigma2", "loglik", "degenerate", "beta", "se"])
        return solve

    @cached_property
    def coef(self) -> DataFrame:
        """(model, stratum, term, beta, se, lci, uci) of the terms that a stratum has."""
        names = F.array(*[F.lit(t) for t in self.terms])
        long = self.solved.select("stratum", "se", F.posexplode("beta").alias("_j", "beta")).where("beta IS NOT NULL")
        se = F.element_at("se", F.col("_j") + 1)
        return long.select(F.lit(self.name).alias("model"), "stratum", F.element_at(names, F.col("_j") + 1).alias("term"),
                           "beta", se.alias("se"), (F.col("beta") - 1.96 * se).alias("lci"),
                           (F.col("beta") + 1.96 * se).alias("uci"))

    @cached_property
    def fit(self) -> DataFrame:
        return self.solved.select(F.lit(self.name).alias("model"), "stratum", "n", "p", "rss", "sigma2", "loglik",
                                  (-2 * F.col("loglik") + 2 * (F.col("p") + 1)).alias("aic"), "degenerate")

    def score(self, df: DataFrame, overrides: dict | None = None, fitted: str = "fitted",
              resid: str | None = "resid") -> DataFrame:
        """``df`` with fitted values and residuals, joined to its strata's coefficients: broadcast while the
        strata are few, by shuffle beyond.  A stratum or level that was not fitted gives null; ``overrides``
        sets terms to constants."""
        overrides, spec = overrides or {}, self.spec
        wide = self.solved.select(F.col("stratum").alias("_stratum"), F.col("beta").alias("_beta"))
        d = join_groups(df.withColumn("_stratum", stratum_key(spec)), wide, ["_stratum"])
        at = {t: F.when(F.col("_beta").isNotNull(), F.coalesce(F.element_at("_beta", j + 1), F.lit(0.0)))
              for j, t in enumerate(self.terms)}
        expr = at[INTERCEPT]
        for t in self.terms[1:]:
            if t in spec.slopes or t in spec.flags or t in self.design.moments:
                expr = expr + at[t] * (F.lit(float(overrides[t])) if t in overrides else F.col(t).cast("double"))
        for f, levels in self.design.levels.items():
            value = F.col(f).cast("string")
            one = F.when(value == F.lit(levels[0]), F.lit(0.0)) if levels else F.lit(0.0)
            for lv in levels[1:]:
                one = one.when(value == F.lit(lv), at[f"{f}{lv}"])
            expr = expr + one
        d = d.withColumn(fitted, expr).drop("_beta", "_stratum")
        return d.withColumn(resid, F.col(spec.outcome).cast("double") - F.col(fitted)) if resid else d
