"""Mapping of the study's roles onto the driver's tables.

* hourly entity panel — ``events``: entity = ``event_type``, ts = hour of
  ``ts``, outcome = hourly mean ``value``; the observed hour plays the
  reference's local time (null where the hour has no source row).
* daily ITS panel — ``lineitem``: entity = return flag ‖ line status, ts =
  ship date, outcome = quantity plus a planted entity offset and a step at
  the cut (raw data have no entity effect).
* covariate by time — ``orders`` daily mean total price (weather's role).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.operators.features import grid_index
from kairos.operators.panel import complete_panel, hour_floor
from kairos.sources.tables import load_table

# Fixed study parameters for the stand-in panels.
EVENTS_CUT = "2024-01-16 00:00:00"
LINEITEM_CUT = "2000-01-01 00:00:00"
LINEITEM_T0 = "1995-01-01 00:00:00"


def r6(c: str | Column, digits: int = 6) -> Column:
    """Output rounding shared bit for bit with the oracle SQL.

    Snap to 1e-9 first (absorbs summation-order noise between engines), then
    round half-up to ``digits`` with the same IEEE operations the SQL uses.
    Magnitudes ≥ 1e9 pass through (they are exact integer sums here); null and
    NaN pass through.
    """
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    snap = F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)
    out = F.floor(snap * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(F.abs(x) < F.lit(1e9), out).otherwise(x)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (event_type, hour): count, mean value, mean JSON ``k``."""
    ev = load_table(spark, sf_dir, "events", ["event_type", "ts", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("double")
    return (ev.groupBy("event_type", hour_floor("ts").alias("ts"))
              .agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("value_mean"),
                   F.avg(k).alias("k_mean")))


def hour_bounds(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """First and last hour of the raw events, in one unshuffled pass over one column."""
    ev = load_table(spark, sf_dir, "events", ["ts"])
    r = ev.agg(hour_floor(F.min("ts")).alias("lo"), hour_floor(F.max("ts")).alias("hi")).first()
    return str(r["lo"]), str(r["hi"])


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete (event_type × hour) panel; ``obs_ts`` is null for absent hours."""
    obs = events_hourly(spark, sf_dir).withColumn("obs_ts", F.col("ts"))
    lo, hi = hour_bounds(spark, sf_dir)
    types = load_table(spark, sf_dir, "events", ["event_type"])
    return complete_panel(obs, ["event_type"], "ts", lo, hi, entities=types)


def indexed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with ``idx``, the 1-based hour since the first of the data."""
    return events_panel(spark, sf_dir).withColumn("idx", grid_index("ts", hour_bounds(spark, sf_dir)[0]))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level events: type, post flag, hour index ``t``, JSON ``k``, raw ``value``."""
    ev = load_table(spark, sf_dir, "events", ["event_type", "ts", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select("event_type", (F.col("ts") >= F.lit(EVENTS_CUT).cast("timestamp_ntz")).alias("post"),
                     grid_index("ts", EVENTS_CUT).cast("double").alias("t"), k.alias("k"), "value")


def entity_offset(entity_flag: Column, entity_status: Column) -> Column:
    """Planted per-entity offset (deterministic, SQL-expressible)."""
    return (F.ascii(entity_flag) - F.lit(65)) * F.lit(0.25) + F.when(entity_status == "O", 1.5).otherwise(0.0)


def lineitem_its(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level ITS table: entity, day, post flag, day index, outcome ``y``."""
    li = load_table(spark, sf_dir, "lineitem",
                    ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice"])
    post = (F.col("l_shipdate") >= F.lit(LINEITEM_CUT).cast("timestamp_ntz"))
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit(LINEITEM_T0[:10]).cast("date"))
    y = F.col("l_quantity") + entity_offset(F.col("l_returnflag"), F.col("l_linestatus")) - F.when(post, 3.0).otherwise(0.0)
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("entity"),
                     F.col("l_shipdate").cast("date").alias("day"),
                     post.alias("post"), day.cast("double").alias("t"),
                     F.bround(F.col("l_discount") * 100, 0).alias("disc"),
                     "l_quantity", "l_extendedprice", y.alias("y"))
