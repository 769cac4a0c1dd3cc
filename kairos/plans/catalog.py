"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables in full; column names match the
oracle SQL in :mod:`kairos.plans.oracle`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.functions.calendar import calendar_columns, intervention_flag, season
from kairos.functions.numeric import fill_missing
from kairos.functions.text import pad_left
from kairos.functions.wind import compass_sector, wind_direction, wind_speed
from kairos.operators import describe as D
from kairos.operators import features as FE
from kairos.operators import filters as FL
from kairos.operators import panel as P
from kairos.operators import series as S
from kairos.operators.correlation import correlation_blocks
from kairos.plans.standins import (
    EVENTS_CUT, LINEITEM_CUT, events_hourly, events_panel, indexed_panel, lineitem_its, r6,
)
from kairos.sources.landing import flatten_response, request_manifest
from kairos.session import checkpoint_dir, materialize
from kairos.sources.sinks import read_years, write_year_files
from kairos.sources.tables import load_table


def panel_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Every event type × every hour, absent hours null."""
    p = events_panel(spark, sf)
    return p.select("event_type", "ts", F.col("n_events").cast("bigint").alias("n_events"),
                    r6("value_mean").alias("value_mean"))


def prepost_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and sd by period; the flag follows the observed hour
    (absent hours have none and are left out)."""
    p = events_panel(spark, sf).withColumn("intervention", intervention_flag("obs_ts", EVENTS_CUT))
    s = D.prepost_summary(p.withColumn("n_events", F.col("n_events").cast("double")), "intervention",
                          ["value_mean", "n_events"], digits=2)
    return s.select("intervention", "variable", "mean", "sd")


def entity_year_stats(spark: SparkSession, sf: str) -> DataFrame:
    """G1/O1: quantity mean, sd, median, IQR by (entity, year), sorted by mean."""
    li = lineitem_its(spark, sf).withColumn("year", F.year("day"))
    g = D.group_stats(li, ["entity", "year"], "l_quantity")
    return g.select("entity", F.col("year").cast("bigint").alias("year"), r6("mean").alias("mean"),
                    r6("sd").alias("sd"), r6("median").alias("median"), r6("iqr").alias("iqr"),
                    F.col("n").cast("bigint").alias("n"))


def request_manifest_q(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier 'sites' × years they shipped in (from lineitem)."""
    sup = load_table(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nat = load_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    li = load_table(spark, sf, "lineitem", ["l_suppkey", "l_shipdate"])
    years = li.groupBy("l_suppkey").agg(F.min(F.year("l_shipdate")).alias("b_year"),
                                        F.max(F.year("l_shipdate")).alias("e_year"))
    site = F.concat_ws("-", pad_left(F.col("n_regionkey").cast("string"), 2),
                       pad_left(F.col("s_nationkey").cast("string"), 3),
                       pad_left(F.col("s_suppkey").cast("string"), 4))
    ents = (sup.join(nat, sup.s_nationkey == nat.n_nationkey, "inner")
               .join(years, sup.s_suppkey == years.l_suppkey, "inner")
               .select(site.alias("site_id"), "s_name", "b_year", "e_year"))
    m = request_manifest(ents, "site_id", "b_year", "e_year")
    return m.select("site_id", "s_name", F.col("pull_year").cast("bigint").alias("pull_year"),
                    "state_code", "county_code", "site_code", "bdate", "edate")


#: Rows of one page of a response, on the average.
PAGE_ROWS = 1000


def json_pages(spark: SparkSession, sf: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """JSON responses (event type, hour, page, body): a one-row header and an array of data rows.

    An hour has as many pages as its counted rows need, whatever its size; rows go to pages by a hash of
    their id.  The header comes from the counts, which partial sums make."""
    ev = load_table(spark, sf, "events", ["event_id", "event_type", "ts", "props"])
    ev = ev.select("event_id", "event_type", P.hour_floor("ts").alias("hour"),
                   F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    counts = ev.groupBy("event_type", "hour").agg(F.count(F.lit(1)).alias("rows"))
    paged = P.join_groups(ev, counts, ["event_type", "hour"]).withColumn(
        "page", F.pmod(F.xxhash64("event_id"), F.ceil(F.col("rows") / F.lit(page_rows))))
    head = F.array(F.struct(F.col("event_type").alias("status"), F.first("rows").alias("rows")))
    return (paged.groupBy("event_type", "hour", "page")
            .agg(F.to_json(F.struct(head.alias("Header"), F.collect_list(F.struct("event_id", "k")).alias("Data")))
                 .alias("body")))


def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """S3: JSON responses of bounded pages, parsed and flattened with the header recycled onto every row."""
    schema = "Header array<struct<status: string, rows: long>>, Data array<struct<event_id: long, k: long>>"
    sent = json_pages(spark, sf)
    flat = flatten_response(sent.select(F.from_json("body", schema).alias("r")).select("r.*"))
    return flat.select("event_id", F.col("header_status").alias("event_type"), F.col("header_rows").alias("n_rows"), "k")


def grid_year_files(spark: SparkSession, sf: str) -> DataFrame:
    """Daily values written as time-sorted year files and read back for the years that a small table
    names: its join prunes the partitions while the query runs.  Monthly means of the study's later years, from the
    first to the last day with an order still pending."""
    orders = load_table(spark, sf, "orders", ["o_orderdate", "o_totalprice", "o_orderstatus"])
    day = F.col("o_orderdate").cast("date")
    daily = orders.groupBy(day.alias("day")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/year-files-{uuid.uuid4().hex}"
    write_year_files(daily, path, "day")
    pending = (orders.where((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= F.lit(LINEITEM_CUT).cast("timestamp_ntz")))
               .groupBy(F.year("o_orderdate").alias("year"))
               .agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")))
    rows = read_years(spark, path, pending).where("day BETWEEN first_day AND last_day")
    out = rows.groupBy("year", F.month("day").alias("month")).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.avg("price").alias("price"))
    return out.select(F.col("year").cast("bigint").alias("year"), F.col("month").cast("bigint").alias("month"), "days", "n",
                      r6("price", 4).alias("price_mean"))


def priority_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly 'view' series, filled in by 'click' hours it lacks."""
    h = events_hourly(spark, sf)
    view = h.where(F.col("event_type") == "view").select("ts", F.lit("view").alias("source"), "value_mean")
    click = h.where(F.col("event_type") == "click").select("ts", F.lit("click").alias("source"), "value_mean")
    u = P.priority_union(view, click, ["ts"])
    return u.select("ts", "source", r6("value_mean").alias("value_mean"))


def semi_count(spark: SparkSession, sf: str) -> DataFrame:
    """Click hours that also have a view (and those that do not)."""
    h = events_hourly(spark, sf)
    view = h.where(F.col("event_type") == "view").select("ts")
    click = h.where(F.col("event_type") == "click").select("ts")
    c = P.semi_count(click, view, ["ts"])
    return c.select(F.col("n_in").cast("bigint").alias("n_in"), F.col("n_out").cast("bigint").alias("n_out"))


def dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """(user, hour) keys that occur more than once."""
    ev = load_table(spark, sf, "events", ["user_id", "ts"]).withColumn("hour", P.hour_floor("ts"))
    d = P.duplicate_keys(ev, ["user_id", "hour"])
    return d.select("user_id", "hour", F.col("n_rows").cast("bigint").alias("n_rows"))


def covariate_join(spark: SparkSession, sf: str) -> DataFrame:
    """Daily entity panel ⟕ daily covariate (orders), strict and na.rm means."""
    li = lineitem_its(spark, sf)
    daily = li.groupBy("entity", "day").agg(F.avg("y").alias("y_mean"), F.count(F.lit(1)).alias("n_lines"))
    orders = load_table(spark, sf, "orders", ["o_orderdate", "o_totalprice", "o_orderstatus"])
    cov = D.spatial_mean(orders.withColumn("day", F.col("o_orderdate").cast("date"))
                               .withColumn("price_if_f", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))),
                         ["day"], strict=["price_if_f"], skip_na=["o_totalprice"])
    j = P.left_join(daily, cov, ["day"])
    return j.select("entity", "day", r6("y_mean").alias("y_mean"), F.col("n_lines").cast("bigint").alias("n_lines"),
                    r6("o_totalprice").alias("price_mean"), r6("price_if_f").alias("price_f_strict"))


def strict_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means per entity, strict (any absent hour → null) and na.rm."""
    p = events_panel(spark, sf).withColumn("day", F.col("ts").cast("date"))
    g = p.groupBy("event_type", "day").agg(D.strict_avg("value_mean").alias("mean_strict"),
                                           F.avg("value_mean").alias("mean_narm"),
                                           F.count_if(F.col("value_mean").isNull()).alias("n_missing"))
    return g.select("event_type", "day", r6("mean_strict").alias("mean_strict"), r6("mean_narm").alias("mean_narm"),
                    F.col("n_missing").cast("bigint").alias("n_missing"))


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar factors from the observed hour + elapsed index."""
    p = events_panel(spark, sf)
    p = p.withColumns(calendar_columns("obs_ts")).withColumn("season", season(F.month("obs_ts"))) \
         .withColumn("intervention", intervention_flag("obs_ts", EVENTS_CUT))
    p = FE.sequence_index(p, ["event_type"], "ts", "time_elapsed", block="2 days")
    return p.select("event_type", "ts", "intervention",
                    *[F.col(c).cast("bigint").alias(c) for c in ("time_of_day", "day_of_week", "month", "year")],
                    "weekend", "time_of_day_cat", "season", "time_elapsed")


def zscore_global(spark: SparkSession, sf: str) -> DataFrame:
    """Z-score of the hourly mean over the whole panel."""
    p = FE.zscore_global(events_panel(spark, sf), ["value_mean", "n_events"])
    return p.select("event_type", "ts", r6("value_mean_scale").alias("value_mean_scale"),
                    r6("n_events_scale").alias("n_events_scale"))


def zscore_entity(spark: SparkSession, sf: str) -> DataFrame:
    """Per-entity z-score of the elapsed-time index."""
    p = indexed_panel(spark, sf).withColumnRenamed("idx", "time_elapsed")
    z = FE.zscore_by(p, "time_elapsed", ["event_type"])
    return z.select("event_type", "ts", F.col("time_elapsed").cast("bigint").alias("time_elapsed"),
                    r6("time_elapsed_scale").alias("time_elapsed_scale"))


def _wind_source(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_table(spark, sf, "events", ["event_id", "ts", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select("event_id", "ts", (F.col("value") - 50.0).alias("u"), (k - 50.0).alias("v"))


def wind_features(spark: SparkSession, sf: str) -> DataFrame:
    """Speed, meteorological direction and 8-sector label from (u, v)."""
    w = _wind_source(spark, sf)
    w = w.withColumn("wind_speed", wind_speed("u", "v")).withColumn("wind_dir", wind_direction("u", "v"))
    return w.select("event_id", r6("wind_speed").alias("wind_speed"), r6("wind_dir").alias("wind_dir"),
                    compass_sector("wind_dir").alias("wind_dir_cat"))


def wind_rose(spark: SparkSession, sf: str) -> DataFrame:
    """Period × sector × speed class counts and within-period shares."""
    w = _wind_source(spark, sf)
    w = w.withColumns({"wind_speed": wind_speed("u", "v"), "wind_dir": wind_direction("u", "v"),
                       "intervention": intervention_flag("ts", EVENTS_CUT)})
    r = D.wind_rose(w, "intervention", "wind_dir", "wind_speed", sectors=8, cuts=(3.0, 6.0, 9.0, 12.0))
    return r.select("intervention", F.col("sector").cast("bigint").alias("sector"), "speed_class",
                    F.col("n").cast("bigint").alias("n"), r6("share").alias("share"))


def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Missing count and share per panel column, in column order."""
    p = events_panel(spark, sf).select("event_type", "ts", "n_events", "value_mean", "k_mean", "obs_ts")
    m = D.missing_summary(p)
    return m.select("variable", F.col("position").cast("bigint").alias("position"),
                    F.col("n_miss").cast("bigint").alias("n_miss"), r6("pct_miss").alias("pct_miss"))


def freq_table(spark: SparkSession, sf: str) -> DataFrame:
    """Value counts with an always-present null row."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts"))
    return D.freq_table(p, ["event_type", "weekend", "time_of_day_cat"]).select("variable", "value", "n")


def contingency(spark: SparkSession, sf: str) -> DataFrame:
    """Event type × weekend label, nulls dropped."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts"))
    return D.contingency(p, "event_type", "weekend").select("event_type", "weekend", F.col("n").cast("bigint").alias("n"))


def complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Panel + features, rows complete in every model column."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts")) \
        .withColumn("intervention", intervention_flag("obs_ts", EVENTS_CUT))
    cc = FL.complete_cases(p, ["event_type", "ts", "value_mean", "k_mean", "intervention", "time_of_day", "weekend"])
    return cc.select("event_type", "ts", r6("value_mean").alias("value_mean"), r6("k_mean").alias("k_mean"),
                     "intervention", F.col("time_of_day").cast("bigint").alias("time_of_day"), "weekend")


def outlier_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Events below mean + 3 sd of the value, which has a long right tail."""
    ev = load_table(spark, sf, "events", ["event_id", "value"])
    f = FL.upper_outlier_filter(ev, "value", "value", 3.0)
    return f.select("event_id", "value")


def zone_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised (quantity, price) pairs on or below the zone line."""
    li = load_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    z = FE.zscore_global(li, ["l_quantity", "l_extendedprice"])
    f = FL.zone_filter(z, "l_quantity_scale", "l_extendedprice_scale")
    return f.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                    r6("l_quantity_scale").alias("resid_scaled"), r6("l_extendedprice_scale").alias("fitted"),
                    r6("zone").alias("zone"))


def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of entity series aligned on time, complete hours only."""
    p = events_panel(spark, sf)
    c = correlation_blocks(p, "ts", "event_type", "value_mean")
    return c.select("entity_1", "entity_2", r6("corr").alias("corr"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    """30 bins of the event value."""
    ev = load_table(spark, sf, "events", ["value"])
    h = D.histogram(ev, "value", bins=30)
    return h.select(F.col("bin").cast("bigint").alias("bin"), r6("x_min").alias("x_min"), r6("x_max").alias("x_max"),
                    F.col("n").cast("bigint").alias("n"))


def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Box-plot statistics of the value by event type."""
    ev = load_table(spark, sf, "events", ["event_type", "value"])
    b = D.box_stats(ev, ["event_type"], "value")
    return b.select("event_type", *[r6(c).alias(c) for c in ("q1", "median", "q3", "lower_fence", "upper_fence",
                                                             "whisker_lo", "whisker_hi")],
                    F.col("n_out").cast("bigint").alias("n_out"), F.col("n").cast("bigint").alias("n"))


def rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean per entity and its trailing 14-row mean."""
    p = events_panel(spark, sf).withColumn("day", F.col("ts").cast("date"))
    d = p.groupBy("event_type", "day").agg(F.avg("value_mean").alias("day_mean"))
    r = S.rolling_mean(d, ["event_type"], "day", "day_mean", k=14, out="roll14")
    return r.select("event_type", "day", r6("day_mean").alias("day_mean"), r6("roll14").alias("roll14"))


def acf_q(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelation of each entity's hourly series, lags 0..100, gaps as NA."""
    p = materialize(indexed_panel(spark, sf).select("event_type", "idx", "value_mean"))
    a = S.acf(p, "idx", "value_mean", series=["event_type"], max_lag=100, block=512)
    return a.select("event_type", F.col("lag").cast("bigint").alias("lag"), r6("acf").alias("acf"),
                    F.col("n_pairs").cast("bigint").alias("n_pairs"))


def pacf_q(spark: SparkSession, sf: str) -> DataFrame:
    """Partial autocorrelation from the ACF table (Durbin–Levinson)."""
    p = materialize(indexed_panel(spark, sf).select("event_type", "idx", "value_mean"))
    a = S.acf(p, "idx", "value_mean", series=["event_type"], max_lag=30, block=512)
    return S.pacf(a, ["event_type"]).select("event_type", F.col("lag").cast("bigint").alias("lag"),
                                              r6("pacf", 4).alias("pacf"))


def impute_cell_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Fill absent hours with the (year, season, weekday, hour) cell mean."""
    p = events_panel(spark, sf)
    feats = {"year": F.year("ts"), "season": season(F.month("ts")), "day_of_week": F.dayofweek("ts"),
             "time_of_day": F.hour("ts")}
    p = p.withColumns(feats)
    cells = D.mean_by(p, ["year", "season", "day_of_week", "time_of_day"], ["value_mean"]) \
        .withColumnRenamed("value_mean", "impute_value")
    j = P.left_join(p, cells, ["year", "season", "day_of_week", "time_of_day"], null_safe=True)
    j = j.withColumn("value_imputed", fill_missing("value_mean", "impute_value"))
    cc = FL.complete_cases(j, ["event_type", "ts", "value_imputed"], keep=["event_type", "ts", "value_imputed", "impute_value"])
    return cc.select("event_type", "ts", r6("value_imputed").alias("value_imputed"),
                     r6("impute_value").alias("impute_value"))


def descriptives(spark: SparkSession, sf: str) -> DataFrame:
    """Global mean, median, sd and IQR of the hourly outcome."""
    p = events_panel(spark, sf).withColumn("all", F.lit("all"))
    g = D.group_stats(p, ["all"], "value_mean", order_by_mean=False)
    return g.select(r6("mean").alias("mean"), r6("median").alias("median"), r6("sd").alias("sd"),
                    r6("iqr").alias("iqr"), F.col("n").cast("bigint").alias("n"))


def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Five-number summary, mean and NA count per weekend label."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts"))
    s = D.column_summary(p, ["event_type"], "value_mean")
    return s.select("event_type", *[r6(c).alias(c) for c in ("min", "q1", "median", "mean", "q3", "max")],
                    F.col("n_na").cast("bigint").alias("n_na"))


def time_window(spark: SparkSession, sf: str) -> DataFrame:
    """Strict time window, then a null-keeping not-in filter on the type."""
    ev = load_table(spark, sf, "events", ["event_id", "ts", "event_type"])
    w = FL.time_window(ev, "ts", "2024-01-03 04:00:00", "2024-01-28 05:00:00")
    w = w.where(FL.not_in_keep_null("event_type", ["error", "signup"]))
    return w.select("event_id", "ts", "event_type")


def qq_points(spark: SparkSession, sf: str) -> DataFrame:
    """Normal QQ points of the event value plus the quartile line."""
    ev = load_table(spark, sf, "events", ["value"])
    q = S.qq_points(ev, "value")
    return q.select(F.col("value").alias("sample"), r6("theoretical").alias("theoretical"),
                    r6("line_slope").alias("line_slope"), r6("line_intercept").alias("line_intercept"))


QUERIES = {
    "panel_complete": panel_complete,
    "prepost_summary": prepost_summary,
    "entity_year_stats": entity_year_stats,
    "request_manifest": request_manifest_q,
    "json_flatten": json_flatten,
    "priority_dedup": priority_dedup,
    "semi_count": semi_count,
    "dup_keys": dup_keys,
    "covariate_join": covariate_join,
    "strict_mean": strict_mean,
    "calendar_features": calendar_features,
    "zscore_global": zscore_global,
    "zscore_entity": zscore_entity,
    "wind_features": wind_features,
    "wind_rose": wind_rose,
    "missing_summary": missing_summary,
    "freq_table": freq_table,
    "contingency": contingency,
    "complete_cases": complete_cases,
    "outlier_filter": outlier_filter,
    "zone_filter": zone_filter,
    "corr_matrix": corr_matrix,
    "grid_year_files": grid_year_files,
    "histogram": histogram,
    "box_stats": box_stats,
    "rolling_mean": rolling_mean,
    "acf": acf_q,
    "pacf": pacf_q,
    "impute_cell_mean": impute_cell_mean,
    "descriptives": descriptives,
    "column_summary": column_summary,
    "time_window": time_window,
    "qq_points": qq_points,
}

from kairos.plans.model_queries import MODEL_QUERIES  # noqa: E402
from kairos.plans.landing_queries import LANDING_QUERIES  # noqa: E402
from kairos.plans.sensitivity import SENSITIVITY_QUERIES  # noqa: E402

QUERIES.update(MODEL_QUERIES)
QUERIES.update(SENSITIVITY_QUERIES)
QUERIES.update(LANDING_QUERIES)
