"""Sensitivity analyses and stratified effects of the study.

All run on the hourly events panel.  Roles: outcome ``value_mean`` (null in absent
hours), entity ``event_type``, intervention from the hour, elapsed index ``t``, and
a single-site covariate ``pm``: the hourly mean of one event type, joined by hour, so
it is missing where that type has no event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.functions.calendar import label_in, season
from kairos.functions.numeric import fill_missing
from kairos.functions.spline import natural_spline_basis, spline_knots
from kairos.operators import describe as D
from kairos.operators import features as FE
from kairos.operators import filters as FL
from kairos.operators import panel as P
from kairos.operators import series as S
from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel
from kairos.operators.report import effect_table, het_test, score
from kairos.plans.model_queries import _events_model_frame, _strata_model
from kairos.plans.standins import EVENTS_CUT, events_hourly, indexed_panel, r6

# Fixed study parameters of the stand-in panel.
MOVED_CUT = "2024-01-15 00:00:00"
PM_TYPE = "click"
LEFT_OUT = ("error", "signup")
ROADSIDE = ("view", "click")


def study_frame(spark: SparkSession, sf: str, cut: str = EVENTS_CUT) -> DataFrame:
    """Panel rows with ``post`` (from the hour) and ``t`` (hours since the first)."""
    p = indexed_panel(spark, sf)
    return p.withColumn("post", F.col("ts") >= F.lit(cut).cast("timestamp_ntz")).withColumn("t", F.col("idx").cast("double"))


def with_pm(spark: SparkSession, sf: str) -> DataFrame:
    """The study rows that have outcome and single-site covariate."""
    pm = events_hourly(spark, sf).where(F.col("event_type") == PM_TYPE).select("ts", F.col("value_mean").alias("pm"))
    return FL.complete_cases(P.left_join(study_frame(spark, sf), pm, ["ts"]),
                             ["event_type", "value_mean", "post", "t", "pm"],
                             keep=["event_type", "value_mean", "post", "t", "pm"])


def _spec(numeric: Sequence[str] = ("t",), outcome: str = "value_mean", **kw) -> ModelSpec:
    return ModelSpec(outcome, flags=["post"], numeric=list(numeric), group="event_type", **kw)


def _effects(models: Sequence[MixedModel], term: str = "post") -> DataFrame:
    """(model, stratum, n, beta, se) of one term, rounded to 4 places: the grid optimum is no closer."""
    out = None
    for m in models:
        one = effect_table(m.coef, term).join(m.fit.select("stratum", "n"), "stratum")
        out = one if out is None else out.unionByName(one)
    return out.select("model", "stratum", F.col("n").cast("bigint").alias("n"), r6("beta", 4).alias("beta"),
                      r6("se", 4).alias("se"))


def pm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """M6: outcome on pm, then the residual (with BLUPs) as a covariate of the main model."""
    rows = with_pm(spark, sf)
    first = MixedModel(rows, ModelSpec("value_mean", numeric=["pm"], group="event_type"), "pm")
    return _effects([MixedModel(score(rows, first, resid="pm_resid"), _spec(["t", "pm_resid"]), "pm_adjusted")])


def same_rows_unadjusted(spark: SparkSession, sf: str) -> DataFrame:
    """M6: the main model on the rows of ``pm_adjusted``."""
    return _effects([MixedModel(with_pm(spark, sf), _spec(), "same_rows")])


def imputed_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Absent outcomes filled with their (year, season, weekday, hour) mean, then the main model."""
    p = study_frame(spark, sf).withColumns({"year": F.year("ts"), "season": season(F.month("ts")),
                                            "day_of_week": F.dayofweek("ts"), "time_of_day": F.hour("ts")})
    cell = ["year", "season", "day_of_week", "time_of_day"]
    means = D.mean_by(p, cell, ["value_mean"]).withColumnRenamed("value_mean", "impute_value")
    p = P.left_join(p, means, cell, null_safe=True).withColumn("filled", fill_missing("value_mean", "impute_value"))
    return _effects([MixedModel(p, _spec(outcome="filled"), "imputed")])


def moved_cut(spark: SparkSession, sf: str) -> DataFrame:
    """M6: the intervention a day earlier."""
    return _effects([MixedModel(study_frame(spark, sf, MOVED_CUT), _spec(), "moved_cut")])


def entity_subset(spark: SparkSession, sf: str) -> DataFrame:
    """M6/M4: without two entities, by REML."""
    rows = study_frame(spark, sf).where(FL.not_in_keep_null("event_type", list(LEFT_OUT)))
    return _effects([MixedModel(rows, _spec(method="REML"), "subset")])


def spline_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """F21 in M2: natural spline of one covariate and a square of another."""
    rows = FL.complete_cases(study_frame(spark, sf), ["event_type", "value_mean", "k_mean", "n_events"],
                             keep=["event_type", "value_mean", "k_mean", "n_events", "post", "t"])
    rows = rows.withColumns(natural_spline_basis("k_mean", spline_knots(rows, "k_mean", 3)))
    rows = rows.withColumn("n1", F.col("n_events").cast("double")).withColumn("n2", F.col("n1") * F.col("n1"))
    return _effects([MixedModel(rows, _spec(["t", "ns1", "ns2", "ns3", "n1", "n2"]), "spline")])


def _roadside(spark: SparkSession, sf: str) -> MixedModel:
    """M5: strata by a list of entities, the index renumbered per entity over complete rows."""
    rows = FL.complete_cases(study_frame(spark, sf), ["event_type", "value_mean", "k_mean"],
                             keep=["event_type", "ts", "value_mean", "k_mean", "post"])
    rows = FE.sequence_index(rows, ["event_type"], "ts", "t", block="2 days")
    rows = rows.withColumn("roadside", label_in("event_type", list(ROADSIDE), "Roadside", "Non-roadside"))
    return MixedModel(rows, _spec(["t", "k_mean"], strata=["roadside"]), "roadside")


def roadside_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Effect in the listed entities and in the others."""
    return _effects([_roadside(spark, sf)])


def het_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hour 1 against 6, and listed entities against the others."""
    hour = effect_table(_strata_model(spark, sf, ("time_of_day",)).coef, "intervention")
    road = effect_table(_roadside(spark, sf).coef, "post")
    both = het_test(hour, [("1", "6")]).unionByName(het_test(road, [("Roadside", "Non-roadside")]))
    return both.select("s1", "s2", *[r6(c, 3).alias(c) for c in ("wald", "pooled_beta", "cochran")])


def slope_effects(spark: SparkSession, sf: str) -> DataFrame:
    """M8: fixed effect of the intercept and of the intercept-and-slope model, and each entity's slope plus
    the fixed effect (no standard error)."""
    rows = _events_model_frame(spark, sf, ()).withColumnRenamed("intervention", "post")
    ri = MixedModel(rows, _spec(["time_elapsed", "k_mean"]), "intercepts")
    spec = ModelSpec("value_mean", slopes=["post"], numeric=["time_elapsed", "k_mean"], group="event_type")
    ris = MixedModel(rows, spec, "intercepts_slopes", share=ri)
    fixed = _effects([ri, ris]).select("model", F.lit("fixed").alias("beta_type"), F.lit(None).cast("string")
                                       .alias("entity"), "beta", "se")
    beta = ris.coefficients()["all"]["post"][0]
    each = ris.ranef.where(F.col("term") == "post").select(
        "model", F.lit("slope").alias("beta_type"), "entity", r6(F.col("blup") + F.lit(beta), 4).alias("beta"),
        F.lit(None).cast("double").alias("se"))
    return fixed.unionByName(each)


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Main model of the hourly panel with fitted values, residuals and the scaled residual."""
    rows = FL.complete_cases(study_frame(spark, sf), ["event_type", "value_mean", "k_mean"],
                             keep=["event_type", "idx", "value_mean", "k_mean", "post", "t"])
    fitted = score(rows, MixedModel(rows, _spec(["t", "k_mean"]), "main"))
    return FE.zscore_global(fitted, ["resid"])


def residual_box(spark: SparkSession, sf: str) -> DataFrame:
    """G17 on model residuals: box statistics by entity."""
    b = D.box_stats(_residuals(spark, sf), ["event_type"], "resid")
    return b.select("event_type", *[r6(c, 4).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence")],
                    F.col("n_out").cast("bigint").alias("n_out"), F.col("n").cast("bigint").alias("n"))


def residual_zone(spark: SparkSession, sf: str) -> DataFrame:
    """P12 on model residuals: rows of each entity on or below the zone line."""
    rows = _residuals(spark, sf)
    z = FL.zone_filter(FE.zscore_global(rows, ["fitted"]), "resid_scale", "fitted_scale")
    return z.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("resid"), 4).alias("mean_resid"))


def residual_acf(spark: SparkSession, sf: str) -> DataFrame:
    """W8/W9 on model residuals: autocorrelation of each entity's residual series, lags 0 to 30."""
    a = S.acf(_residuals(spark, sf), "idx", "resid", series=["event_type"], max_lag=30, block=512)
    return a.select("event_type", F.col("lag").cast("bigint").alias("lag"), r6("acf", 4).alias("acf"),
                    F.col("n_pairs").cast("bigint").alias("n_pairs"))


def residual_qq(spark: SparkSession, sf: str) -> DataFrame:
    """G18 on model residuals: normal QQ points with the quartile line."""
    q = S.qq_points(_residuals(spark, sf), "resid")
    return q.select(F.col("rank").cast("bigint").alias("rank"), r6("resid", 4).alias("sample"),
                    r6("theoretical").alias("theoretical"), r6("line_slope", 4).alias("line_slope"),
                    r6("line_intercept", 4).alias("line_intercept"))


SENSITIVITY_QUERIES = {f.__name__: f for f in (
    pm_adjusted, same_rows_unadjusted, imputed_refit, moved_cut, entity_subset, spline_mixed, roadside_effects,
    het_pairs, slope_effects, residual_box, residual_zone, residual_acf, residual_qq)}
