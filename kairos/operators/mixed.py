"""Linear and linear mixed models from the distributed Gram.

Model: y = Xβ + Zb + e, b ~ N(0, σ²·LLᵀ) per entity, Z = [1, slopes...] (the
first q columns of X).  For entity i with Gram G_i of A = [X y]:

    K_i = I + Lᵀ(Z_iᵀZ_i)L,   M = Σ_i G_i − Σ_i (Z_iᵀA_i)ᵀ L K_i⁻¹ Lᵀ (Z_iᵀA_i)

then β = M_xx⁻¹M_xy, RSS = M_yy − βᵀM_xy and the (RE)ML profile likelihood is
closed form given Σ log|K_i|.  Each evaluation of a batch of candidate L's
is one distributed pass over the per-entity Gram table (``mapInPandas``
partial sums + grouped sum + one ``applyInPandas`` per (stratum, candidate));
the driver only sees (stratum, candidate, log-likelihood) triples and picks
the next batch (grid refinement for q = 1).  With slopes, each pass also sums the
score and the Hessian (``newton``) and the search takes Newton steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.functions.numeric import chi2_tail
from kairos.operators.panel import join_groups
from kairos.operators.newton import (TOLERANCE, candidates, entity_sums, newton_step, score_and_hessian, starts,
                                     symmetric)
from kairos.operators.gram import INTERCEPT, Design, ModelSpec, gram_table, resolve_design, stratum_totals, unpack

LOG2PI = math.log(2 * math.pi)


def aliased_mask(Gxx: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Indices of X columns kept after dropping zero-variance / aliased ones
    (sequential pivot in term order, like R's ``lm`` dropping later columns)."""
    keep: list[int] = []
    for j in range(Gxx.shape[0]):
        d = Gxx[j, j]
        if not d > 0:
            continue
        if keep:
            S = Gxx[np.ix_(keep, keep)]
            b = Gxx[keep, j]
            r = d - b @ np.linalg.solve(S, b)
        else:
            r = d
        if r > tol * d:
            keep.append(j)
    return keep


def lower(params, q: int) -> np.ndarray:
    L = np.zeros((q, q))
    L[np.tril_indices(q)] = params
    return L


def correction(G: np.ndarray, L: np.ndarray) -> tuple[np.ndarray, float]:
    """(Z'A)ᵀ L K⁻¹ Lᵀ (Z'A) and log|K| for one entity."""
    q = L.shape[0]
    ZtA = G[:q, :]
    K = np.eye(q) + L.T @ G[:q, :q] @ L
    W = L @ np.linalg.solve(K, L.T)
    return ZtA.T @ W @ ZtA, float(np.linalg.slogdet(K)[1])


def profile(M: np.ndarray, N: float, logdet: float, keep: list[int], method: str) -> dict:
    """β, RSS and (RE)ML log-likelihood from the adjusted Gram M (m×m, y last)."""
    Mxx = M[np.ix_(keep, keep)]
    Mxy = M[keep, -1]
    C = np.linalg.cholesky(Mxx)
    beta = np.linalg.solve(C.T, np.linalg.solve(C, Mxy))
    rss = float(M[-1, -1] - beta @ Mxy)
    p = len(keep)
    if N <= p or rss <= 1e-12 * max(1.0, float(M[-1, -1])):
        # saturated or exact fit: coefficients exist, variance and likelihood do not
        return {"beta": beta, "rss": max(rss, 0.0), "loglik": math.nan, "sigma2": math.nan, "Mxx": Mxx, "p": p}
    if method == "REML":
        dfree = N - p
        ll = -dfree / 2 * (LOG2PI + math.log(rss / dfree) + 1) - logdet / 2 - float(np.log(np.diag(C)).sum())
        sigma2 = rss / dfree
    else:
        ll = -N / 2 * (LOG2PI + math.log(rss / N) + 1) - logdet / 2
        sigma2 = rss / N
    return {"beta": beta, "rss": rss, "loglik": ll, "sigma2": sigma2, "Mxx": Mxx, "p": p}


@dataclass
class StratumFit:
    stratum: str
    keep: list
    params: np.ndarray
    res: dict
    n: float
    n_entities: int


class MixedModel:
    """Fit one spec on one table; ``coef``, ``fit`` and ``ranef`` are DataFrames."""

    def __init__(self, df: DataFrame, spec: ModelSpec, name: str = "model", adjust_sigma: bool = True,
                 optimise: bool = True, share: "MixedModel | None" = None, strict: bool = True,
                 max_expand: int = 4, max_rounds: int = 60):
        """``share``: reuse another fit's design and per-entity Gram (same data,
        same columns in the same order, grouped by the same entity column);
        only the random-effect structure or method may differ."""
        self.spark: SparkSession = df.sparkSession
        self.spec = spec
        self.name = name
        self.q = spec.q()
        self.adjust_sigma = adjust_sigma
        if share is not None:
            if share.spec.strata != spec.strata or (spec.group and share.spec.group != spec.group):
                raise ValueError("shared Gram must have the same strata and grouping")
            self.design = Design(spec, share.design.terms, share.design.levels, share.design.moments,
                                 share.design.dropped)
            self.m = share.m
            self.gram, self.totals, self.n_entities = share.gram, share.totals, share.n_entities
        else:
            self.design = resolve_design(df, spec)
            self.m = len(self.design.terms) + 1
            self.gram = gram_table(df, self.design)
            self.totals, self.n_entities = stratum_totals(self.gram, self.m)
        self.keep = {s: aliased_mask(G[:-1, :-1]) for s, G in self.totals.items()}
        for s, kp in self.keep.items():
            if any(j not in kp for j in range(self.q)):
                raise ValueError(f"random-effect column aliased in stratum {s}")
        self.converged: dict[str, bool] = {}
        self.max_expand, self.max_rounds = max_expand, max_rounds
        self.jobs = 0       # passes over the Gram table that a search of several random effects took
        self.fits = self._optimise() if optimise else {}
        lost = sorted(s for s, ok in self.converged.items() if not ok)
        if lost and strict:
            raise RuntimeError(f"variance search did not converge in strata {lost}; "
                               "strict=False returns the fit with converged = false")

    def profile_at(self, params: list[np.ndarray]) -> list[dict]:
        """Fixed-parameter profiles, all parameter vectors in one distributed pass."""
        tri = self.m * (self.m + 1) // 2
        vecs: dict = {}
        for r in self._summed({s: list(params) for s in self.totals}).collect():
            vecs.setdefault((r["cand"], r["_stratum"]), np.zeros(tri + 1))[r["k"]] = r["v"]
        out = []
        for (c, s), v in sorted(vecs.items()):
            G = self.totals[s]
            res = self._raw_loglik(profile(G - unpack(v[:tri], self.m), G[0, 0], v[tri], self.keep[s],
                                           self.spec.method), s)
            out.append({"stratum": s, "params": params[c], **res})
        return out

    def _raw_loglik(self, res: dict, stratum: str) -> dict:
        """REML's −½log|X'V⁻¹X| depends on the column scaling used internally;
        shift it back to the original columns (−Σ log sd_j).  ML is invariant."""
        if self.spec.method == "REML":
            kept = [self.design.terms[j] for j in self.keep[stratum]]
            res["loglik"] -= sum(math.log(self.design.moments[t][1]) for t in kept if t in self.design.moments)
        return res

    # ---- distributed candidate evaluation ---------------------------------
    def _summed(self, cands: dict[str, list[np.ndarray]]) -> DataFrame:
        """(_stratum, cand, k, v): Σ corrections (k < m(m+1)/2) and Σ log|K| of every candidate."""
        q, m = self.q, self.m
        tri = m * (m + 1) // 2
        iu = np.triu_indices(m)
        Ls = {s: [lower(c, q) for c in cs] for s, cs in cands.items()}
        th = {s: np.array([float(L[0, 0]) ** 2 for L in ls]) for s, ls in Ls.items()}

        def partial(batches):
            # per (stratum): K × (m(m+1)/2 + 1) running sums
            acc: dict = {}
            for pdf in batches:
                if q == 1:
                    # rank-one corrections: Σ_i θ/(1+n_iθ)·s_i s_iᵀ for all θ in one BLAS call
                    for s, sub in pdf.groupby("_stratum", sort=False):
                        if s not in th:
                            continue
                        g = np.stack(sub["g"].to_numpy())
                        S = g[:, :m]                      # first row of G_i = column sums
                        n = S[:, 0]
                        W = th[s][None, :] / (1.0 + n[:, None] * th[s][None, :])   # E × K
                        # s_i s_iᵀ as upper-triangle rows, then one matrix product for all θ
                        corr = sum(W[a:a + 2048].T @ (S[a:a + 2048][:, iu[0]] * S[a:a + 2048][:, iu[1]])
                                   for a in range(0, len(S), 2048))
                        ld = np.log1p(n[:, None] * th[s][None, :]).sum(axis=0)
                        vec = np.column_stack([corr, ld])
                        acc[s] = acc[s] + vec if s in acc else vec
                else:
                    for s, sub in pdf.groupby("_stratum", sort=False):
                        if s not in Ls:
                            continue
                        G = symmetric(np.stack(sub["g"].to_numpy()), m)
                        vec = np.stack([entity_sums(G, L, derivatives=False) for L in Ls[s]])
                        vec = np.column_stack([vec[:, :m * m].reshape(-1, m, m)[:, iu[0], iu[1]], vec[:, m * m]])
                        acc[s] = acc[s] + vec if s in acc else vec
            if acc:
                parts = []
                for s, vec in acc.items():
                    K = vec.shape[0]
                    parts.append(pd.DataFrame({"_stratum": s,
                                               "cand": np.repeat(np.arange(K, dtype=np.int32), tri + 1),
                                               "k": np.tile(np.arange(tri + 1, dtype=np.int32), K),
                                               "v": vec.ravel()}))
                yield pd.concat(parts, ignore_index=True)

        return (self.gram.select("_stratum", "g")
                .mapInPandas(partial, "_stratum string, cand int, k int, v double")
                .groupBy("_stratum", "cand", "k").agg(F.sum("v").alias("v")))

    def _evaluate(self, cands: dict[str, list[np.ndarray]]) -> dict[str, list[float]]:
        m, tri = self.m, self.m * (self.m + 1) // 2
        totals, keep, method = self.totals, self.keep, self.spec.method
        shift = {s: self._raw_loglik({"loglik": 0.0}, s)["loglik"] for s in self.totals}

        def crit(pdf: pd.DataFrame) -> pd.DataFrame:
            # one group per stratum: K candidates × (m(m+1)/2 + 1) sums (bounded by the spec)
            s = pdf["_stratum"].iloc[0]
            K = int(pdf["cand"].max()) + 1
            vec = np.zeros((K, tri + 1))
            vec[pdf["cand"].to_numpy(), pdf["k"].to_numpy()] = pdf["v"].to_numpy()
            G = totals[s]
            lls = []
            for ci in range(K):
                try:
                    ll = profile(G - unpack(vec[ci, :tri], m), G[0, 0], vec[ci, tri], keep[s], method)["loglik"]
                except (np.linalg.LinAlgError, ValueError):
                    ll = -np.inf
                lls.append(float(ll) + shift[s])
            return pd.DataFrame({"_stratum": s, "cand": np.arange(K, dtype=np.int32), "loglik": lls})

        rows = self._summed(cands).groupBy("_stratum").applyInPandas(crit, "_stratum string, cand int, loglik double").collect()
        out = {s: [-np.inf] * len(cs) for s, cs in cands.items()}
        for r in rows:
            v = r["loglik"]
            out[r["_stratum"]][r["cand"]] = v if v is not None and np.isfinite(v) else -np.inf
        return out

    def _final(self, params: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, float]]:
        """Σ corrections and Σ log|K| at the chosen parameters (collected: strata × m²)."""
        q, m = self.q, self.m
        Ls = {s: lower(p, q) for s, p in params.items()}
        tri = m * (m + 1) // 2
        iu = np.triu_indices(m)

        def partial(batches):
            acc: dict = {}
            for pdf in batches:
                for s, g in zip(pdf["_stratum"], pdf["g"]):
                    C, ld = correction(unpack(np.asarray(g, dtype=np.float64), m), Ls[s])
                    vec = np.append(C[iu], ld)
                    acc[s] = acc[s] + vec if s in acc else vec
            if acc:
                yield pd.DataFrame({"_stratum": [s for s in acc for _ in range(tri + 1)],
                                    "k": np.tile(np.arange(tri + 1, dtype=np.int32), len(acc)),
                                    "v": np.concatenate(list(acc.values()))})

        rows = (self.gram.select("_stratum", "g").mapInPandas(partial, "_stratum string, k int, v double")
                .groupBy("_stratum", "k").agg(F.sum("v").alias("v")).collect())
        vecs: dict = {}
        for r in rows:
            vecs.setdefault(r["_stratum"], np.zeros(tri + 1))[r["k"]] = r["v"]
        return {s: (unpack(v[:tri], m), v[tri]) for s, v in vecs.items()}

    # ---- search ------------------------------------------------------------
    def _search_q1(self) -> dict[str, float]:
        strata = list(self.totals)
        grid = [0.0, *np.logspace(-4, 3, 160)]
        cur = {s: list(grid) for s in strata}
        ll = self._evaluate({s: [np.array([v]) for v in cur[s]] for s in strata})
        best = {s: int(np.argmax(ll[s])) for s in strata}
        # an optimum at the upper end: move the grid up until it is interior
        self.converged = {s: True for s in strata}
        for step in range(self.max_expand + 1):
            edge = [s for s in strata if best[s] == len(cur[s]) - 1 and np.isfinite(ll[s][best[s]])]
            if not edge:
                break
            if step == self.max_expand:
                self.converged.update({s: False for s in edge})
                break
            for s in edge:
                cur[s] = list(np.logspace(math.log10(cur[s][-2]), math.log10(cur[s][-1]) + 3, 161))
            more = self._evaluate({s: [np.array([v]) for v in cur[s]] for s in edge})
            ll.update(more)
            best.update({s: int(np.argmax(more[s])) for s in edge})
        for _ in range(2):
            nxt = {}
            for s in strata:
                g, b = cur[s], best[s]
                lo = g[b - 1] if b > 0 else 0.0
                hi = g[b + 1] if b + 1 < len(g) else g[b] * 4.0
                nxt[s] = list(np.linspace(lo, hi, 161))
            ll = self._evaluate({s: [np.array([v]) for v in nxt[s]] for s in strata})
            cur = nxt
            best = {s: int(np.argmax(ll[s])) for s in strata}
        return {s: cur[s][best[s]] for s in strata}

    def _derivatives(self, cands: dict[str, list[np.ndarray]]) -> dict[str, list[tuple]]:
        """Log-likelihood with its derivatives of every candidate of every stratum, in one job.

        Sums travel as (stratum, candidate, k, v) with map-side partial sums; a candidate at which the
        columns degenerate has a likelihood of minus infinity."""
        q, m = self.q, self.m
        Ls = {s: [lower(c, q) for c in cs] for s, cs in cands.items()}

        def partial(batches):
            acc: dict = {}
            for pdf in batches:
                for s, sub in pdf.groupby("_stratum", sort=False):
                    if s in Ls:
                        G = symmetric(np.stack(sub["g"].to_numpy()), m)
                        vec = np.stack([entity_sums(G, L) for L in Ls[s]])
                        acc[s] = acc[s] + vec if s in acc else vec
            for s, vec in acc.items():
                k, n = vec.shape
                yield pd.DataFrame({"_stratum": s, "cand": np.repeat(np.arange(k, dtype=np.int32), n),
                                    "k": np.tile(np.arange(n, dtype=np.int32), k), "v": vec.ravel()})

        long = (self.gram.select("_stratum", "g").mapInPandas(partial, "_stratum string, cand int, k int, v double")
                .groupBy("_stratum", "cand", "k").agg(F.sum("v").alias("v")).toPandas())
        self.jobs += 1
        out: dict[str, list[tuple]] = {s: [(-np.inf, None, None, None)] * len(cs) for s, cs in cands.items()}
        for (s, c), sub in long.groupby(["_stratum", "cand"]):
            vec = np.zeros(len(sub))
            vec[sub["k"].to_numpy()] = sub["v"].to_numpy()
            try:
                got = score_and_hessian(vec, self.totals[s], Ls[s][c], self.keep[s], self.spec.method)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(got[0]) and np.isfinite(got[1]).all() and np.isfinite(got[2]).all():
                out[s][c] = got
        return out

    def _search_newton(self, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Newton and scoring steps in the Cholesky factor of any number of random effects: one job picks the start
        from a grid (unless given), every other one takes the best of some step lengths."""
        strata, q = list(self.totals), self.q
        rms = {s: np.sqrt(np.maximum(np.diag(G)[:q] / G[0, 0], 1e-300)) for s, G in self.totals.items()}
        scale = {s: x[np.tril_indices(q)[0]] for s, x in rms.items()}
        if start is None:
            cands = {s: starts(rms[s]) for s in strata}
            ll = self._evaluate(cands)
            self.jobs += 1
            start = {s: cands[s][int(np.argmax(ll[s]))] for s in strata}
        at = dict(start)
        here = {s: x[0] for s, x in self._derivatives({s: [at[s]] for s in strata}).items()}
        done = {s: False for s in strata}
        for _ in range(self.max_rounds):
            cands = {}
            for s in strata:
                if done[s] or here[s][1] is None:
                    continue
                step, gain = newton_step(here[s][1], here[s][2], scale[s])
                if gain < TOLERANCE:
                    at[s], done[s] = at[s] + step, True
                else:
                    cands[s] = candidates(at[s], step, here[s][3])
            if not cands:
                break
            for s, got in self._derivatives(cands).items():
                best = int(np.argmax([x[0] for x in got]))
                if got[best][0] > here[s][0]:
                    at[s], here[s] = cands[s][best], got[best]
                else:       # no step gains anything that can be told from rounding
                    done[s] = True
        self.converged.update(done)
        for s, x in at.items():
            L = lower(x, q)
            at[s] = (L * np.where(np.diag(L) < 0, -1.0, 1.0))[np.tril_indices(q)]    # the factor with no negative diagonal
        return at

    def _optimise(self) -> dict[str, StratumFit]:
        strata = list(self.totals)
        if self.q == 0:
            params = {s: np.zeros(0) for s in strata}
            final = {s: (np.zeros((self.m, self.m)), 0.0) for s in strata}
        elif self.q == 1:
            params = {s: np.array([v]) for s, v in self._search_q1().items()}
            final = self._final(params)
        else:
            params = self._search_newton()
            final = self._final(params)
        fits = {}
        for s in strata:
            G = self.totals[s]
            C, ld = final[s]
            res = self._raw_loglik(profile(G - C, G[0, 0], ld, self.keep[s], self.spec.method), s)
            fits[s] = StratumFit(s, self.keep[s], params[s], res, G[0, 0], self.n_entities.get(s, 0))
        return fits

    # ---- result tables -----------------------------------------------------
    def _raw_scale(self, f: StratumFit) -> tuple[list[str], np.ndarray, np.ndarray]:
        terms = [self.design.terms[j] for j in f.keep]
        res = f.res
        N, p = f.n, res["p"]
        sigma2 = res["sigma2"]
        if self.spec.method == "ML" and self.q > 0 and self.adjust_sigma:
            sigma2 = sigma2 * N / (N - p) if N > p else math.nan
        if self.q == 0:
            sigma2 = res["rss"] / (N - p) if N > p else math.nan
        cov = sigma2 * np.linalg.inv(res["Mxx"])
        Tm = np.eye(p)
        for a, t in enumerate(terms):
            if t in self.design.moments:
                mu, sd = self.design.moments[t]
                Tm[a, a] = 1.0 / sd
                if terms[0] == INTERCEPT:
                    Tm[0, a] = -mu / sd
        return terms, Tm @ res["beta"], Tm @ cov @ Tm.T

    def coefficients(self) -> dict[str, dict[str, tuple[float, float]]]:
        out = {}
        for s, f in self.fits.items():
            terms, b, cov = self._raw_scale(f)
            out[s] = {t: (float(b[i]), float(math.sqrt(max(cov[i, i], 0.0)))) for i, t in enumerate(terms)}
        return out

    @property
    def coef(self) -> DataFrame:
        rows = []
        for s, d in self.coefficients().items():
            for t, (b, se) in d.items():
                rows.append((self.name, s, t, b, se, b - 1.96 * se, b + 1.96 * se))
        return self.spark.createDataFrame(rows, "model string, stratum string, term string, beta double, se double, "
                                                "lci double, uci double")

    @property
    def fit(self) -> DataFrame:
        rows = []
        nvar = self.q * (self.q + 1) // 2
        for s, f in self.fits.items():
            p = f.res["p"]
            k = p + 1 + nvar
            ll = f.res["loglik"]
            if self.q == 0:
                ll = -f.n / 2 * (LOG2PI + math.log(f.res["rss"] / f.n) + 1) if math.isfinite(f.res["loglik"]) else math.nan
            rows.append((self.name, s, int(f.n), p, f.n_entities, [float(x) for x in f.params],
                         float(f.res["sigma2"]), float(ll), float(-2 * ll + 2 * k), self.spec.method,
                         self.converged.get(s, True), not math.isfinite(f.res["loglik"])))
        return self.spark.createDataFrame(rows, "model string, stratum string, n long, p int, n_entities int, "
                                                "theta array<double>, sigma2 double, loglik double, aic double, "
                                                "method string, converged boolean, degenerate boolean")

    @property
    def ranef(self) -> DataFrame:
        """M8: BLUPs per (stratum, entity), computed next to the Gram rows."""
        if self.q == 0:
            return self.spark.createDataFrame([], "model string, stratum string, entity string, term string, "
                                                  "blup double")
        q, m, name = self.q, self.m, self.name
        info = {s: (lower(f.params, q), f.keep, f.res["beta"]) for s, f in self.fits.items()}
        zterms = self.design.terms[:q]

        def blups(batches):
            for pdf in batches:
                out = []
                for s, e, g in zip(pdf["_stratum"], pdf["_entity"], pdf["g"]):
                    L, keep, beta = info[s]
                    G = unpack(np.asarray(g, dtype=np.float64), m)
                    K = np.eye(q) + L.T @ G[:q, :q] @ L
                    W = L @ np.linalg.solve(K, L.T)
                    b = W @ (G[:q, -1] - G[np.ix_(range(q), keep)] @ beta)
                    out += [(name, s, e, zterms[i], float(b[i])) for i in range(q)]
                yield pd.DataFrame(out, columns=["model", "stratum", "entity", "term", "blup"])

        return self.gram.select("_stratum", "_entity", "g").mapInPandas(
            blups, "model string, stratum string, entity string, term string, blup double")


def predictor(model: MixedModel, overrides: dict | None = None):
    """Return ``f(df) -> DataFrame`` adding ``fitted`` (fixed + random part).

    Coefficients are a few literals per stratum (maps keyed by stratum), so
    scoring is a narrow codegen projection; BLUPs join on (stratum, entity).
    ``overrides`` pins a term to a constant (counterfactual, M10).
    """
    spec, design = model.spec, model.design
    coefs = model.coefficients()
    overrides = overrides or {}

    def term_map(t):
        return F.create_map(*[x for s, d in coefs.items() for x in (F.lit(s), F.lit(d.get(t, (0.0, 0.0))[0]))])

    def apply(df: DataFrame) -> DataFrame:
        sk = F.concat_ws("|", *[F.col(s).cast("string") for s in spec.strata]) if spec.strata else F.lit("all")
        d = df.withColumn("_stratum", sk)
        # a stratum or factor level that was not fitted gives null, never the reference value
        expr = F.element_at(term_map(INTERCEPT), F.col("_stratum"))
        for t in [*spec.slopes, *[f for f in spec.flags if f not in spec.slopes], *design.moments]:
            x = F.lit(float(overrides[t])) if t in overrides else F.col(t).cast("double")
            expr = expr + F.element_at(term_map(t), F.col("_stratum")) * x
        for f, lv in design.levels.items():
            m = F.create_map(*[x for s, dd in coefs.items() for v in lv
                               for x in (F.lit(f"{s}\u0001{v}"), F.lit(dd.get(f"{f}{v}", (0.0, 0.0))[0]))])
            key = F.concat(F.col("_stratum"), F.lit("\u0001"), F.col(f).cast("string"))
            expr = expr + F.element_at(m, key)
        d = d.withColumn("fixed", expr)
        if model.q > 0:
            re = (model.ranef.groupBy("stratum", "entity").pivot("term", design.terms[:model.q]).agg(F.first("blup")))
            re = re.select(F.col("stratum").alias("_stratum"), F.col("entity").alias("_entity"),
                           *[F.col(f"`{t}`").alias(f"_b{i}") for i, t in enumerate(design.terms[:model.q])])
            d = join_groups(d.withColumn("_entity", F.col(spec.group).cast("string")), re, ["_stratum", "_entity"])
            rand = F.coalesce(F.col("_b0"), F.lit(0.0))
            for i, t in enumerate(spec.slopes, start=1):
                x = F.lit(float(overrides[t])) if t in overrides else F.col(t).cast("double")
                rand = rand + F.coalesce(F.col(f"_b{i}"), F.lit(0.0)) * x
            d = d.withColumn("fitted", F.col("fixed") + rand).drop(*[f"_b{i}" for i in range(model.q)], "_entity")
        else:
            d = d.withColumn("fitted", F.col("fixed"))
        return d.drop("_stratum")

    return apply


def lr_test(ll_small: float, ll_big: float, df: int) -> tuple[float, float]:
    """Likelihood-ratio statistic and χ² upper-tail p for any degrees of freedom."""
    stat = max(2.0 * (ll_big - ll_small), 0.0)
    return stat, chi2_tail(stat, df)
