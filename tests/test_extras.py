"""Spline basis, projection, JSON landing, sinks and the streaming landing."""

import json
import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.functions.geo import lambert_conformal
from kairos.functions.spline import natural_spline_basis
from kairos.sources.landing import read_responses, request_manifest
from kairos.sources.sinks import write_table
from kairos.streaming.landing import hourly_landing_stream
from tests.conftest import SF001


def test_spline_linear_beyond_boundary(spark):
    knots = [0.0, 3.0, 6.0, 10.0]
    xs = [10.0, 11.0, 12.0, 13.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    b = np.array([list(r) for r in df.select(*natural_spline_basis("x", knots).values()).collect()])
    second = b[2:] - 2 * b[1:-1] + b[:-2]
    assert np.allclose(second, 0.0, atol=1e-9)  # natural: linear past the last knot


def test_lambert_origin(spark):
    df = spark.createDataFrame([(-74.0, 40.0 + 10.0 / 60.0)], "lon double, lat double")
    r = df.select(*[v.alias(k) for k, v in lambert_conformal("lon", "lat").items()]).first()
    assert abs(r["x"] - 300000.0 / (1200.0 / 3937.0)) < 1e-6 and abs(r["y"]) < 1e-6


def test_json_responses_flatten(spark):
    d = tempfile.mkdtemp(prefix="kairos-json-")
    for site, year in (("36-005-0110", 2018), ("36-005-0110", 2019)):
        body = {"Header": [{"status": "Success", "rows": 2}],
                "Data": [{"date_local": f"{year}-01-01", "time_local": "00:00", "sample_measurement": 1.5},
                         {"date_local": f"{year}-01-01", "time_local": "01:00", "sample_measurement": None}]}
        with open(os.path.join(d, f"{site}_{year}.json"), "w") as fh:
            json.dump(body, fh)
    schema = T.StructType([
        T.StructField("Header", T.ArrayType(T.StructType([T.StructField("status", T.StringType()),
                                                          T.StructField("rows", T.LongType())]))),
        T.StructField("Data", T.ArrayType(T.StructType([T.StructField("date_local", T.StringType()),
                                                        T.StructField("time_local", T.StringType()),
                                                        T.StructField("sample_measurement", T.DoubleType())])))])
    df = read_responses(spark, d, schema)
    rows = df.collect()
    assert len(rows) == 4 and all(r["header_status"] == "Success" for r in rows)
    assert sum(r["sample_measurement"] is None for r in rows) == 2


def test_manifest_and_partitioned_sink(spark):
    ents = spark.createDataFrame([("36-005-0110", 2018, 2020), ("34-013-0003", 2019, 2019)],
                                 "site_id string, b int, e int")
    m = request_manifest(ents, "site_id", "b", "e")
    assert m.count() == 4 and m.where(F.col("county_code") == "005").count() == 3
    out = tempfile.mkdtemp(prefix="kairos-sink-")
    write_table(m, out + "/t", partition_by=["pull_year"], sort_within=["site_id"])
    back = spark.read.parquet(out + "/t").where(F.col("pull_year") == 2019)
    assert back.count() == 2


def test_streaming_landing_matches_batch(spark):
    schema = spark.read.parquet(f"{SF001}/events.parquet").schema
    s = hourly_landing_stream(spark, SF001, schema, "event_type", "ts", "value", glob="events.parquet")
    q = s.writeStream.format("memory").queryName("kairos_landing").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM kairos_landing")
    batch = (spark.read.parquet(f"{SF001}/events.parquet")
             .groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
             .agg(F.count(F.lit(1)).alias("n")))
    assert got.count() == batch.count()
    assert got.join(batch, ["event_type", "hour", "n"]).count() == batch.count()
