"""Registered model queries (M1-M14) over the stand-in panels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.functions.calendar import calendar_columns, intervention_flag
from kairos.operators import features as FE
from kairos.operators import filters as FL
from kairos.operators.gram import INTERCEPT, ModelSpec, resolve_design, gram_table
from kairos.operators.mixed import MixedModel, lr_test
from kairos.operators.report import detrend_effect, effect_table, het_test, its_series, score
from kairos.functions.spline import natural_basis, spline_knots
from kairos.operators.smoother import PenalisedTrend
from kairos.operators.store import StoredModel, fitted, load
from kairos.operators.strata import StratifiedOLS
from kairos.plans.standins import EVENTS_CUT, event_rows, events_panel, indexed_panel, lineitem_its, r6

# Fixed-θ list of the profile-likelihood query (θ = σ_b²/σ²).
PROFILE_THETAS = (0.0, 0.0001, 0.001, 0.01, 0.1, 1.0)

COEF_COLS = ["model", "stratum", "term", "beta", "se", "lci", "uci"]


def _li(spark, sf):
    return lineitem_its(spark, sf).withColumn("dow", F.dayofweek("day"))


def _main_spec(**kw) -> ModelSpec:
    base = dict(outcome="y", numeric=["t", "disc"], flags=["post"], factors={"dow": [str(d) for d in range(1, 8)]},
                group="entity")
    base.update(kw)
    return ModelSpec(**base)


def _coef_out(coef: DataFrame) -> DataFrame:
    return coef.select("model", "stratum", "term", *[r6(c).alias(c) for c in ("beta", "se", "lci", "uci")])


def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """§4.3: per-entity Gram of [1, post, t, disc, y] (unscaled, exact sums)."""
    li = _li(spark, sf)
    spec = ModelSpec("y", numeric=["t", "disc"], flags=["post"], group="entity", scale=False)
    design = resolve_design(li, spec)
    names = [*design.terms, "y"]
    m = len(names)
    iu = np.triu_indices(m)
    row_t = F.array(*[F.lit(names[i]) for i in iu[0]])
    col_t = F.array(*[F.lit(names[j]) for j in iu[1]])
    g = gram_table(li, design, checkpoint=False)
    ex = g.select(F.col("_entity").alias("entity"), F.posexplode("g").alias("k", "value"))
    return ex.select("entity", F.element_at(row_t, F.col("k") + 1).alias("row_term"),
                     F.element_at(col_t, F.col("k") + 1).alias("col_term"), r6("value").alias("value"))


def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    """M1: per-entity OLS of the outcome on the day index (Gram + solve)."""
    li = _li(spark, sf)
    m = StratifiedOLS(li, ModelSpec("y", numeric=["t"], strata=["entity"]), "ols")
    return m.coef.select("stratum", "term", r6("beta").alias("beta"))


def lmm_profile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """M2 at fixed θ: β (intercept, post) and ML log-likelihood per θ."""
    li = _li(spark, sf)
    m = MixedModel(li, ModelSpec("y", flags=["post"], group="entity"), "profile", optimise=False)
    prof = m.profile_at([np.array([math.sqrt(t)]) for t in PROFILE_THETAS])
    rows = [(float(p["params"][0] ** 2), float(p["beta"][0]), float(p["beta"][1]), float(p["loglik"])) for p in prof]
    out = spark.createDataFrame(rows, "theta double, beta_int double, beta_post double, loglik double")
    return out.select(r6("theta").alias("theta"), r6("beta_int").alias("beta_int"), r6("beta_post").alias("beta_post"),
                      r6("loglik").alias("loglik"))


def lmm_effect(spark: SparkSession, sf: str) -> DataFrame:
    """M2: random-intercept ML fit of the ITS model; coefficient table."""
    return _coef_out(fitted(_li(spark, sf), _main_spec(), "ri_ml").coef)


def lmm_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """M3: random intercept + random slope on the intervention flag (ML)."""
    spec = _main_spec(flags=[], slopes=["post"])
    return _coef_out(MixedModel(_li(spark, sf), spec, "ris_ml").coef)


def lmm_reml(spark: SparkSession, sf: str) -> DataFrame:
    """M4: random-intercept REML fit."""
    return _coef_out(MixedModel(_li(spark, sf), _main_spec(method="REML"), "ri_reml").coef)


def lmm_ranef(spark: SparkSession, sf: str) -> DataFrame:
    """M8: BLUPs of the random-intercept model."""
    r = fitted(_li(spark, sf), _main_spec(), "ri_ml").ranef
    return r.select("model", "stratum", "entity", "term", r6("blup", 4).alias("blup"))


def model_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihood and AIC of OLS, RI and RI+slope fits, plus the LR
    test of RI against RI+slope (2 df)."""
    li = _li(spark, sf)
    ri = MixedModel(li, _main_spec(), "ri")
    # same columns in the same order (post right after the intercept): one Gram pass serves all three
    fits = [MixedModel(li, _main_spec(group=None), "fixed", share=ri), ri,
            MixedModel(li, _main_spec(flags=[], slopes=["post"]), "ris", share=ri)]
    rows = []
    for m in fits:
        r = m.fit.first()
        rows.append((m.name, float(r["loglik"]), float(r["aic"]), int(r["p"]), None, None))
    stat, p = lr_test(rows[1][1], rows[2][1], 2)
    rows.append(("lr_ri_vs_ris", None, None, 2, stat, p))
    out = spark.createDataFrame(rows, "model string, loglik double, aic double, df int, lr_stat double, "
                                      "p_value double")
    return out.select("model", r6("loglik").alias("loglik"), r6("aic").alias("aic"), "df",
                      r6("lr_stat").alias("lr_stat"), r6("p_value").alias("p_value"))


def _events_model_frame(spark, sf, strata=("weekend",)) -> DataFrame:
    """Complete-case hourly panel with ITS features; the elapsed index is
    recomputed within (stratum, entity) over complete rows (Q16)."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts")) \
        .withColumn("intervention", intervention_flag("obs_ts", EVENTS_CUT))
    cc = FL.complete_cases(p, ["value_mean", "k_mean", "intervention", "time_of_day", "weekend"],
                           keep=["event_type", "ts", "value_mean", "k_mean", "intervention", "time_of_day", "weekend"])
    return FE.sequence_index(cc, [*strata, "event_type"], "ts", "time_elapsed", block="2 days")


def _strata_model(spark, sf, strata=("weekend",)) -> StoredModel:
    df = _events_model_frame(spark, sf, strata)
    # a factor that is a stratum is constant there
    factors = {} if "time_of_day" in strata else {"time_of_day": [str(h) for h in range(24)]}
    spec = ModelSpec("value_mean", numeric=["time_elapsed", "k_mean"], flags=["intervention"], factors=factors,
                     group="event_type", strata=list(strata))
    return fitted(df, spec, "strata_" + "_".join(strata))


def strata_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Intervention effect per weekend/weekday stratum."""
    e = effect_table(_strata_model(spark, sf).coef, "intervention")
    return e.select("model", "stratum", *[r6(c).alias(c) for c in ("beta", "se", "lci", "uci")])


def hourly_effects(spark: SparkSession, sf: str) -> DataFrame:
    """M5: intervention effect per hour-of-day stratum (24 fits, one Gram pass)."""
    e = effect_table(_strata_model(spark, sf, ("time_of_day",)).coef, "intervention")
    return e.select("model", "stratum", *[r6(c, 4).alias(c) for c in ("beta", "se")],
                    *[r6(c, 3).alias(c) for c in ("lci", "uci")])


def het_test_q(spark: SparkSession, sf: str) -> DataFrame:
    """Weekend vs weekday heterogeneity of the intervention effect."""
    e = effect_table(_strata_model(spark, sf).coef, "intervention")
    h = het_test(e)
    return h.select("s1", "s2", *[r6(c).alias(c) for c in ("wald", "p_wald", "pooled_beta", "cochran", "p_cochran")])


def its_counterfactual(spark: SparkSession, sf: str) -> DataFrame:
    """Daily actual vs counterfactual predictions and 14-day means."""
    li = _li(spark, sf)
    m = fitted(li, _main_spec(), "ri_ml")
    s = its_series(li, m, "post", "t", "day", k=14)
    return s.select("date", *[r6(c, 4).alias(c) for c in ("pred_actual", "pred_counterf", "roll_actual", "roll_counterf")])


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The main model saved, loaded from its folder alone, and scored: mean prediction, counterfactual
    and residual per entity and period."""
    li = _li(spark, sf)
    m = load(spark, fitted(li, _main_spec(), "ri_ml").path)
    s = score(score(li, m, fitted="actual"), m, overrides={"post": 0.0}, fitted="counterf", resid=None)
    return s.groupBy("entity", F.col("post").cast("int").alias("post")).agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c), 4).alias(c) for c in ("actual", "counterf", "resid")])


def detrend_effect_q(spark: SparkSession, sf: str) -> DataFrame:
    """M7: residualise outcome and flag on covariates (REML RI), then OLS."""
    li = _li(spark, sf)
    res = detrend_effect(li, "y", "post", "t", ["disc"], {"dow": [str(d) for d in range(1, 8)]}, "entity")
    return _coef_out(res["ols"].coef)


def residual_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Score the RI model of the raw event values (a long right tail),
    drop residuals above mean(y) + 3·sd(y), refit, and report the intervention
    effect and the rows before and after."""
    ev = event_rows(spark, sf)
    spec = ModelSpec("value", numeric=["t", "k"], flags=["post"], group="event_type")
    m = MixedModel(ev, spec, "ri_ml")
    scored = score(ev, m)
    kept = FL.upper_outlier_filter(scored, "resid", "value", 3.0)
    m2 = MixedModel(kept, spec, "ri_ml_no_outliers")
    both = effect_table(m.coef, "post").unionByName(effect_table(m2.coef, "post"))
    rows = m.fit.unionByName(m2.fit).select("model", "stratum", "n")
    return both.join(rows, ["model", "stratum"]).select(
        "model", "stratum", *[r6(c, 4).alias(c) for c in ("beta", "se", "lci", "uci")], "n")


MODEL_QUERIES = {
    "gram_matrix": gram_matrix,
    "ols_simple": ols_simple,
    "lmm_profile_grid": lmm_profile_grid,
    "lmm_effect": lmm_effect,
    "lmm_slopes": lmm_slopes,
    "lmm_reml": lmm_reml,
    "lmm_ranef": lmm_ranef,
    "model_compare": model_compare,
    "strata_effects": strata_effects,
    "hourly_effects": hourly_effects,
    "het_test": het_test_q,
    "its_counterfactual": its_counterfactual,
    "stored_scores": stored_scores,
    "detrend_effect": detrend_effect_q,
    "residual_outliers": residual_outliers,
}


def trend_smoother(spark: SparkSession, sf: str) -> DataFrame:
    """Per-entity natural-spline (3 df) least-squares trend of the
    hourly outcome over the elapsed index (one Gram pass, 5 OLS solves)."""
    from kairos.functions.spline import natural_spline_basis, spline_knots
    p = indexed_panel(spark, sf).withColumn("idx", F.col("idx").cast("double"))
    knots = spline_knots(p.where(F.col("value_mean").isNotNull()), "idx", 3)
    p = p.withColumns(natural_spline_basis("idx", knots))
    m = StratifiedOLS(p, ModelSpec("value_mean", numeric=["ns1", "ns2", "ns3"], strata=["event_type"]), "smoother")
    s = m.score(p, fitted="trend", resid=None)
    return s.select("event_type", "ts", r6("value_mean").alias("value_mean"), r6("trend", 4).alias("trend"))


MODEL_QUERIES["trend_smoother"] = trend_smoother


def _outcome_span(p: DataFrame) -> tuple[float, float]:
    row = p.where(F.col("value_mean").isNotNull()).agg(F.min("idx"), F.max("idx")).first()
    return float(row[0]), float(row[1])


def penalised_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Per-entity penalised B-spline trend of the hourly outcome, its smoothness chosen by
    generalised cross-validation."""
    p = indexed_panel(spark, sf).withColumn("idx", F.col("idx").cast("double"))
    trend = PenalisedTrend(p, "value_mean", "idx", *_outcome_span(p), strata=["event_type"], intervals=12)
    s = trend.score(p, penalty="penalty")
    return s.select("event_type", "ts", r6("value_mean").alias("value_mean"), r6("trend", 4).alias("trend"),
                    r6("penalty", 4).alias("penalty"))


def spline_basis(spark: SparkSession, sf: str) -> DataFrame:
    """natural cubic spline basis (3 columns) of the hourly covariate, at every hour that has one."""
    p = events_panel(spark, sf).where(F.col("k_mean").isNotNull())
    basis = natural_basis("k_mean", spline_knots(p, "k_mean", 3))
    return p.select("event_type", "ts", *[r6(c).alias(n) for n, c in basis.items()])


MODEL_QUERIES["penalised_trend"] = penalised_trend
MODEL_QUERIES["spline_basis"] = spline_basis
