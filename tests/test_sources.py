"""Sources and sinks S1 to S12 on files."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairos.operators.gram import ModelSpec
from kairos.operators.mixed import MixedModel
from kairos.sources.landing import (
    empty_like, flatten_response, inline_table, read_csv, read_grid_files, read_responses, timestamp_from_name,
)
from kairos.sources.sinks import load_model_tables, save_model_tables, write_csv, write_table


def test_inline_and_empty_tables(spark):
    t = inline_table(spark, [("a", 1), ("b", None)], "k string, n int")
    e = empty_like(spark, t.schema)
    assert t.count() == 2 and e.count() == 0 and e.schema == t.schema
    assert e.unionByName(t).count() == 2


def test_header_is_recycled_and_empty_data_gives_no_rows(spark):
    schema = "Header array<struct<status: string>>, Data array<struct<v: double>>"
    rows = [([("ok",)], [(1.0,), (None,)]), ([("no data",)], []), ([], [(2.0,)]), (None, None)]
    got = flatten_response(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.header_status or "", r.v or 0.0) for r in got)) == [("", 2.0), ("ok", 0.0), ("ok", 1.0)]


def test_responses_with_manifest(spark, tmp_path):
    for site in ("a", "b", "c"):
        body = {"Header": [{"status": "Success"}], "Data": [{"v": float(len(site))}]}
        (tmp_path / f"{site}.json").write_text(json.dumps(body))
    schema = T.StructType.fromDDL("Header array<struct<status: string>>, Data array<struct<v: double>>")
    manifest = spark.createDataFrame([(f"file:{tmp_path}/{s}.json", s, 2018) for s in ("a", "b")], "source_file string, site string, pull_year int")
    got = read_responses(spark, str(tmp_path), schema, manifest).collect()
    assert sorted((r.site or "") for r in got) == ["", "a", "b"] and all(r.header_status == "Success" for r in got)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, dt.datetime(2024, 1, 1)), ("b", None, None)], "k string, v double, t timestamp_ntz")
    write_csv(df, f"{tmp_path}/c")
    back = read_csv(spark, f"{tmp_path}/c", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_grid_files_with_bands_glob_and_hour_from_name(spark, tmp_path):
    for hour in ("20180101.0400", "20180101.0500"):
        (tmp_path / f"GRID_A{hour}.csv.x").write_text("")
        with gzip.open(tmp_path / f"GRID_A{hour}.csv.gz", "wt") as f:
            f.write("-74.0,40.5,1.0,2.0\n-74.0,40.6,3.0,4.0\n")
    g = read_grid_files(spark, str(tmp_path), "x double, y double, band1 double, band2 double", "*.csv.gz",
                        ["temp", "humidity"], "csv")
    assert g.columns[:4] == ["x", "y", "temp", "humidity"] and g.count() == 4
    hours = g.select(timestamp_from_name("file_name", 7, 8, "yyyyMMddHHmm").alias("h")).distinct().collect()
    assert {r.h for r in hours} == {dt.datetime(2018, 1, 1, 4), dt.datetime(2018, 1, 1, 5)}


def test_model_tables_and_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i % 3}", float(i % 7), float(i % 5 + i % 3)) for i in range(90)],
                               "g string, x double, y double")
    m = MixedModel(df, ModelSpec("y", numeric=["x"], group="g"), "m")
    save_model_tables({"coef": m.coef, "ranef": m.ranef, "fit": m.fit}, f"{tmp_path}/m")
    back = load_model_tables(spark, f"{tmp_path}/m")
    assert back["coef"].count() == 2 and back["ranef"].count() == 3 and back["fit"].first().converged
    write_table(df, f"{tmp_path}/t", ["g"], ["x"])
    write_table(df.limit(3), f"{tmp_path}/t", ["g"], mode="append")
    assert spark.read.parquet(f"{tmp_path}/t").where(F.col("g") == "g1").count() >= 30
