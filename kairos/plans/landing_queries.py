"""Registered queries over files that they write themselves from the driver's tables: CSV, JSON responses,
gridded files (S4–S9), with the parsing helpers; null-keeping filters (P6); the lookup join (J4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.functions.calendar import calendar_columns, parse_local_time
from kairos.functions.numeric import clamp_below
from kairos.functions.text import composite_key, str_sub, substr_range
from kairos.operators import filters as FL
from kairos.operators import panel as P
from kairos.plans.standins import events_hourly, events_panel, indexed_panel, r6
from kairos.session import checkpoint_dir
from kairos.sources.landing import read_csv, read_grid_files, read_responses, response_schema, timestamp_from_name
from kairos.sources.sinks import write_csv


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_landing(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly values written as CSV with separate date and time texts, read with an explicit
    schema, parsed to local time, keyed and clamped."""
    path = _folder(spark, "csv")
    h = events_hourly(spark, sf)
    write_csv(h.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("date"),
                       F.date_format("ts", "HH:mm").alias("time"), "value_mean", "k_mean"), path)
    back = read_csv(spark, path, "event_type string, date string, time string, value_mean double, k_mean double")
    back = back.withColumn("ts", parse_local_time("date", "time"))
    return back.select("event_type", "ts", composite_key("event_type", "ts").alias("entity_key"),
                       r6(clamp_below("value_mean", 40.0, 0.1)).alias("value_clamped"), r6("k_mean").alias("k_mean"))


def response_files(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON response file per event type and day (24 rows at most), gathered in one scan; a
    manifest of the files gives type and day back."""
    path = _folder(spark, "responses")
    h = events_hourly(spark, sf).withColumn("day", F.to_date("ts"))
    data = F.collect_list(F.struct(F.hour("ts").alias("hour"), F.col("n_events").alias("n"), F.col("value_mean").alias("v")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("Success").alias("status"), F.count(F.lit(1)).alias("rows"))).alias("Header"),
                              data.alias("Data")))
    sent = h.groupBy("event_type", "day").agg(body.alias("value"))
    # one row per partition folder, hence one file per response
    sent.repartition("event_type", "day").write.partitionBy("event_type", "day").text(path)
    schema = response_schema(
        T.StructType([T.StructField("status", T.StringType()), T.StructField("rows", T.LongType())]),
        T.StructType([T.StructField("hour", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("v", T.DoubleType())]))
    name = F.col("source_file")
    manifest = (spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"))
                .select("source_file", F.regexp_extract(name, "event_type=([^/]+)/", 1).alias("event_type"),
                        F.regexp_extract(name, "day=([^/]+)/", 1).cast("date").alias("day")))
    rows = read_responses(spark, path, schema, manifest)
    return rows.select("event_type", "day", F.col("hour").cast("bigint").alias("hour"), "n", r6("v").alias("value_mean"),
                       F.col("header_status").alias("status"), F.col("header_rows").alias("n_rows"))


def grid_files(spark: SparkSession, sf: str) -> DataFrame:
    """Gridded day files (hour × kind, two bands) whose folder names carry the time stamp, read
    in one scan, bands named by position, stamps parsed."""
    path = _folder(spark, "grid")
    h = events_hourly(spark, sf)
    h.select(F.concat(F.lit("A"), F.date_format("ts", "yyyyMMdd"), F.lit(".0000")).alias("stamp"), F.hour("ts").alias("x"),
             F.ascii("event_type").alias("y"), F.col("value_mean").alias("band1"), F.col("n_events").cast("double").alias("band2")) \
        .repartition("stamp").sortWithinPartitions("x", "y").write.partitionBy("stamp").parquet(path)
    back = read_grid_files(spark, path, "x int, y int, band1 double, band2 double", band_names=["value", "events"])
    return back.select(timestamp_from_name("stamp", 2, 1, "yyyyMMddHHmm").alias("ts"),
                       substr_range("stamp", 2, 5).alias("year"), str_sub("stamp", 2, -6).alias("day"),
                       F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), r6("value").alias("value"),
                       F.col("events").cast("bigint").alias("events"))


def not_in_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Panel rows that are not at the weekend; rows without an observed hour, whose label is null, stay."""
    p = events_panel(spark, sf).withColumns(calendar_columns("obs_ts"))
    return p.where(FL.not_in_keep_null("weekend", ["weekend"])).select("event_type", "ts", "weekend")


def series_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means over types by running index, their date and hour looked up in the distinct pairs of
    the panel."""
    p = indexed_panel(spark, sf)
    means = p.groupBy("idx").agg(F.avg("value_mean").alias("value_mean"), F.count("value_mean").alias("n_types"))
    got = P.lookup_join(means, p.withColumn("date", F.to_date("ts")), "idx", ["ts", "date"])
    return got.select(F.col("idx").cast("bigint").alias("idx"), "ts", "date", r6("value_mean").alias("value_mean"), "n_types")


LANDING_QUERIES = {f.__name__: f for f in (csv_landing, response_files, grid_files, not_in_nulls, series_lookup)}
