"""Scalar functions and null rules (§1.3 N-rows) on tiny literal frames."""

import datetime as dt

from pyspark.sql import functions as F

from kairos.functions.calendar import hour_bucket_label, intervention_flag, season, weekday_label
from kairos.functions.numeric import clamp_below, fill_missing, round_half_even
from kairos.functions.text import str_sub, substr_range
from kairos.functions.wind import compass_sector, wind_direction, wind_speed
from kairos.operators.filters import complete_cases, not_in_keep_null
from kairos.operators.series import norm_quantile
from kairos.sources.landing import timestamp_from_name


def test_compass_boundaries(spark):
    df = spark.createDataFrame([(0.0,), (22.5,), (337.5,), (360.0,), (22.4999,), (180.0,), (None,)], "d double")
    got = [r[0] for r in df.select(compass_sector("d")).collect()]
    assert got == ["North", "North-east", "North", "North", "North", "South", None]


def test_wind_direction_and_speed(spark):
    df = spark.createDataFrame([(0.0, -1.0), (0.0, 0.0), (3.0, 4.0)], "u double, v double")
    rows = df.select(wind_direction("u", "v").alias("d"), wind_speed("u", "v").alias("s")).collect()
    assert rows[0]["d"] == 360.0 and rows[1]["d"] == 180.0 and rows[2]["s"] == 5.0


def test_not_in_keeps_null(spark):  # N2
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(not_in_keep_null("x", ["a"])).count() == 2


def test_complete_cases_drops_nan(spark):  # N6
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3), (2.0, None)], "a double, b int")
    assert complete_cases(df, ["a", "b"]).count() == 1


def test_half_even_rounding(spark):  # N11
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,)], "x double")
    assert [r[0] for r in df.select(round_half_even("x", 1)).collect()][:1] == [0.2]
    assert df.select(round_half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_weekend_is_friday_saturday(spark):  # Q1
    days = [dt.datetime(2024, 1, d) for d in (5, 6, 7, 8)]  # Fri, Sat, Sun, Mon
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "t timestamp_ntz")
    got = [r[0] for r in df.select(weekday_label(F.dayofweek("t"))).collect()]
    assert got == ["weekend", "weekend", "weekday", "weekday", None]
    got2 = [r[0] for r in df.select(weekday_label(F.dayofweek("t"), (1, 7))).collect()]
    assert got2 == ["weekday", "weekend", "weekend", "weekday", None]


def test_intervention_boundary_and_null(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 3, 21, 23),), (dt.datetime(2020, 3, 22, 0),), (None,)],
                               "t timestamp_ntz")
    assert [r[0] for r in df.select(intervention_flag("t", "2020-03-22 00:00:00")).collect()] == [False, True, None]


def test_season_and_hour_bucket(spark):
    df = spark.createDataFrame([(12, 23), (2, 0), (3, 5), (None, None)], "m int, h int")
    rows = df.select(season("m"), hour_bucket_label("h")).collect()
    assert [tuple(r) for r in rows] == [("Winter", "22-23"), ("Winter", "0-1"), ("Spring", "4-5"), (None, None)]


def test_fill_and_clamp(spark):
    df = spark.createDataFrame([(None, 5.0), (float("nan"), 6.0), (0.5, 7.0), (3.0, 8.0)], "a double, b double")
    rows = df.select(fill_missing("a", "b"), clamp_below("a")).collect()
    assert [r[0] for r in rows] == [5.0, 6.0, 0.5, 3.0]
    assert rows[2][1] == 0.1 and rows[3][1] == 3.0 and rows[0][1] is None


def test_substrings(spark):
    df = spark.createDataFrame([("36-005-0110",)], "s string")
    r = df.select(substr_range("s", 1, 2), substr_range("s", 4, 6), str_sub("s", 4, -6)).first()
    assert tuple(r) == ("36", "005", "005")


def test_timestamp_from_file_name(spark):
    name = "NLDAS_FORA0125_H.A20180101.0400.002.grb.SUB.grb_and_some_tail_pad"
    df = spark.createDataFrame([(name,)], "n string")
    # stamp sits at 1-based positions 19..31 ("20180101.0400"): str_sub(name, 19, -(len - 30))
    got = df.select(timestamp_from_name("n", 19, len(name) - 30, "yyyyMMddHHmm")).first()[0]
    assert got == dt.datetime(2018, 1, 1, 4, 0)


def test_norm_quantile(spark):
    import statistics
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_quantile("p")).collect()]
    for p, g in zip(ps, got):
        assert abs(g - statistics.NormalDist().inv_cdf(p)) < 1e-8
