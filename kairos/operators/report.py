"""Model reporting: scoring, effect tables, heterogeneity tests, ITS series,
detrended re-estimation (M7, M9, M10, M12, M13, M14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.functions.tails import chi2_upper_tail, normal_upper_tail
from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel, predictor
from kairos.operators.series import rolling_mean


def score(df: DataFrame, model: MixedModel, overrides: dict | None = None, fitted: str = "fitted",
          resid: str | None = "resid") -> DataFrame:
    """Fitted values (fixed + BLUP) and residuals; ``overrides`` pins
    terms for counterfactual prediction (e.g. ``{"post": 0}``)."""
    out = predictor(model, overrides)(df)
    if fitted != "fitted":
        out = out.withColumnRenamed("fitted", fitted)
    out = out.drop("fixed")
    if resid:
        out = out.withColumn(resid, F.col(model.spec.outcome).cast("double") - F.col(fitted))
    return out


def effect_table(coef: DataFrame, term: str, z: float = 1.96) -> DataFrame:
    """The term's estimate per (model, stratum) with a normal CI."""
    return (coef.where(F.col("term") == term)
                .select("model", "stratum", "beta", "se",
                        (F.col("beta") - z * F.col("se")).alias("lci"),
                        (F.col("beta") + z * F.col("se")).alias("uci")))


def het_test(effects: DataFrame, pairs: Sequence[tuple[str, str]] | None = None, abs_z: bool = True) -> DataFrame:
    """Wald z and Cochran Q for the difference between two strata.

    ``effects``: (stratum, beta, se).  All ordered pairs s1 < s2 by default
    (a self-join of the small effect table), or the listed pairs.  With
    ``abs_z = False`` the p value is ``2·P(Z > z)`` without ``abs`` (the
    reference's form, which exceeds 1 when z < 0).
    """
    a = effects.select(F.col("stratum").alias("s1"), F.col("beta").alias("b1"), F.col("se").alias("se1"))
    b = effects.select(F.col("stratum").alias("s2"), F.col("beta").alias("b2"), F.col("se").alias("se2"))
    if pairs:
        want = effects.sparkSession.createDataFrame(list(pairs), "s1 string, s2 string")
        j = want.join(a, "s1").join(b, "s2")
    else:
        j = a.join(b, F.col("s1") < F.col("s2"))
    v1, v2 = F.col("se1") ** 2, F.col("se2") ** 2
    j = j.withColumn("wald", (F.col("b1") - F.col("b2")) / F.sqrt(v1 + v2))
    zc = F.abs(F.col("wald")) if abs_z else F.col("wald")
    j = j.withColumn("p_wald", normal_upper_tail(zc) * 2.0)
    j = j.withColumn("pooled_beta", (F.col("b1") / v1 + F.col("b2") / v2) / (1 / v1 + 1 / v2))
    j = j.withColumn("cochran", (F.col("b1") - F.col("pooled_beta")) ** 2 / v1
                     + (F.col("b2") - F.col("pooled_beta")) ** 2 / v2)
    j = j.withColumn("p_cochran", chi2_upper_tail("cochran", 1))
    return j.select("s1", "s2", "wald", "p_wald", "pooled_beta", "cochran", "p_cochran")


def its_series(df: DataFrame, model: MixedModel, flag: str, index_col: str, date_col: str | Column,
               k: int = 14) -> DataFrame:
    """Actual vs counterfactual (flag = 0) predictions averaged over
    entities per time index, attached to dates, averaged per day and smoothed
    with a trailing k-row mean.  Dates come from the rows themselves (never
    from a separately joined lookup, so no fan-out, Q6)."""
    d = df.withColumn("_date", F.col(date_col).cast("date") if isinstance(date_col, str) else date_col.cast("date"))
    act = score(d, model, fitted="pred_actual", resid=None)
    if flag in model.spec.slopes:
        both = score(act, model, overrides={flag: 0.0}, fitted="pred_counterf", resid=None)
    else:       # a fixed term only: the same prediction without it, no second scoring
        spec = model.spec
        stratum = F.concat_ws("|", *[F.col(s).cast("string") for s in spec.strata]) if spec.strata else F.lit("all")
        beta = F.create_map(*[x for s, c in model.coefficients().items()
                              for x in (F.lit(s), F.lit(c.get(flag, (0.0, 0.0))[0]))])
        both = act.withColumn("pred_counterf", F.col("pred_actual")
                              - F.element_at(beta, stratum) * F.col(flag).cast("double"))
    per_idx = both.groupBy(index_col).agg(F.avg("pred_actual").alias("pred_actual"),
                                          F.avg("pred_counterf").alias("pred_counterf"),
                                          F.min("_date").alias("date"))
    daily = per_idx.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.avg("pred_actual").alias("pred_actual"), F.avg("pred_counterf").alias("pred_counterf"))
    daily = daily.withColumn("_series", F.lit(1))
    r = rolling_mean(daily, ["_series"], "date", "pred_actual", k=k, out="roll_actual")
    r = rolling_mean(r, ["_series"], "date", "pred_counterf", k=k, out="roll_counterf")
    return r.drop("_series")


def detrend_effect(df: DataFrame, outcome: str, flag: str, time_col: str, numeric: Sequence[str],
                   factors: dict, group: str, method: str = "REML") -> dict:
    """M7: partial out covariates from both outcome and treatment with random
    intercept models, then OLS of outcome residuals on treatment residuals and
    time.  Residuals include the BLUPs (conditional residuals, like ``resid``)."""
    base = df.withColumn("_flag", F.col(flag).cast("double"))
    my = MixedModel(base, ModelSpec(outcome, numeric=numeric, factors=factors, group=group, method=method), "y_on_cov")
    mf = MixedModel(base, ModelSpec("_flag", numeric=numeric, factors=factors, group=group, method=method), "flag_on_cov")
    s = score(base, my, fitted="_fy", resid="y_resid")
    s = score(s, mf, fitted="_ff", resid="flag_resid")
    ols = MixedModel(s, ModelSpec("y_resid", numeric=["flag_resid", time_col]), "detrended")
    return {"outcome_model": my, "flag_model": mf, "ols": ols}
