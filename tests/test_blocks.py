"""Blocked correlation, year files with run-time pruning, JSON pages of bounded size."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairos.operators.correlation import correlation_blocks
from kairos.plans import catalog
from kairos.sources.sinks import read_years, write_year_files
from tests.conftest import SF01


@pytest.mark.parametrize("block,chunk", [(256, 1024), (2, 3), (1, 1000), (5, 7)])
def test_correlation_equals_numpy(spark, block, chunk):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 9)) @ rng.normal(size=(9, 9)) + 1e6
    rows = [(t, f"e{e}", float(data[t, e])) for t in range(40) for e in range(9) if not (t == 7 and e == 3)]
    rows += [(11, "e0", None), (None, "e0", 1.0), (12, None, 1.0)]
    df = spark.createDataFrame(rows, "t int, e string, v double").repartition(4)
    got = {(r.entity_1, r.entity_2): r["corr"] for r in correlation_blocks(df, "t", "e", "v", block, chunk).collect()}
    want = np.corrcoef(np.delete(data, 7, axis=0).T)
    assert len(got) == 81
    for a in range(9):
        for b in range(9):
            assert got[f"e{a}", f"e{b}"] == pytest.approx(want[a, b], abs=1e-9)


def test_correlation_of_odd_series(spark):
    rows = [(t, e, v) for t in range(5) for e, v in (("flat", 3.0), ("up", float(t)), ("down", float(-t)))]
    df = spark.createDataFrame(rows, "t int, e string, v double")
    got = {(r.entity_1, r.entity_2): r["corr"] for r in correlation_blocks(df, "t", "e", "v").collect()}
    assert got["up", "down"] == pytest.approx(-1.0) and got["flat", "up"] is None and got["flat", "flat"] is None
    assert correlation_blocks(df.where("t = 1"), "t", "e", "v").where("corr IS NOT NULL").count() == 0
    assert correlation_blocks(df.where("NOT (e = 'up' AND t < 9)").unionByName(
        spark.createDataFrame([(99, "up", 1.0)], df.schema)), "t", "e", "v").count() == 0
    assert correlation_blocks(df.where("false"), "t", "e", "v").count() == 0


def test_five_thousand_entities(spark):
    """All 25 million pairs: correlations of a sine family are the cosines of the phases' differences."""
    n, t = 5000, 24
    df = spark.range(n * t, numPartitions=8).select(
        (F.col("id") % t).cast("int").alias("t"), F.floor(F.col("id") / t).cast("string").alias("e"))
    df = df.withColumn("v", 5 + F.cos(2 * math.pi * (F.col("t") / t) + 2 * math.pi * F.col("e").cast("double") / n))
    got = correlation_blocks(df, "t", "e", "v")
    off = F.abs(F.col("corr") - F.cos(2 * math.pi * (F.col("entity_1").cast("double") - F.col("entity_2").cast("double")) / n))
    row = got.agg(F.count("corr").alias("n"), F.max(off).alias("off")).first()
    assert row["n"] == n * n and row["off"] < 1e-9


def test_year_files_are_pruned_at_run_time(spark, tmp_path):
    days = spark.range(0, 365 * 8).select(F.expr("date_add(DATE '2010-01-01', CAST(id AS INT))").alias("day"), "id")
    path = str(tmp_path / "y")
    write_year_files(days.repartition(6), path, "day")
    assert sorted(p.name for p in (tmp_path / "y").glob("year=*")) == [f"year={y}" for y in range(2010, 2018)]
    side = tmp_path / "side"
    spark.createDataFrame([(y, "in" if y in (2012, 2015) else "out") for y in range(2010, 2018)], "year int, kind string") \
        .write.parquet(str(side))
    got = read_years(spark, path, spark.read.parquet(str(side)).where("kind = 'in'"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan
    assert got.count() == 366 + 365 and {r[0] for r in got.select("year").distinct().collect()} == {2012, 2015}
    import pyarrow.parquet as pq
    for f in (tmp_path / "y").rglob("*.parquet"):
        values = pq.read_table(f, columns=["day"])["day"].to_pylist()
        assert values == sorted(values)


def test_grid_query_prunes(spark):
    plan = catalog.grid_year_files(spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan


def test_pages_are_bounded_with_one_hot_hour(spark, tmp_path):
    hot = spark.range(30_000).select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 05:30:00'").alias("ts"), F.lit('{"k": 3}').alias("props"))
    rest = spark.range(30_000, 30_050).select(
        F.col("id").alias("event_id"), F.lit("click").alias("event_type"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 05:00:00' + make_interval(0, 0, 0, 0, CAST(id % 9 AS INT))").alias("ts"),
        F.lit(None).cast("string").alias("props"))
    hot.unionByName(rest).write.parquet(str(tmp_path / "events.parquet"))
    pages = [json.loads(r.body) for r in catalog.json_pages(spark, str(tmp_path), 500).collect()]
    assert max(len(p["Data"]) for p in pages) < 700 and sum(len(p["Data"]) for p in pages) == 30_050
    assert {p["Header"][0]["rows"] for p in pages if p["Header"][0]["status"] == "view"} == {30_000}
    flat = catalog.json_flatten(spark, str(tmp_path))
    assert flat.count() == 30_050 and flat.where("event_type = 'view' AND n_rows = 30000 AND k = 3").count() == 30_000
