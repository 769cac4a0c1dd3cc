"""Calendar factors, intervention flags and label columns.

All timestamps are TIMESTAMP_NTZ carrying *standard* local time (no DST).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's labels.
WEEKEND_LABEL = "weekend"
WEEKDAY_LABEL = "weekday"
# Season names by month: Dec-Feb Winter, Mar-May Spring, Jun-Aug Summer, Sep-Nov Fall.
SEASONS = (((12, 1, 2), "Winter"), ((3, 4, 5), "Spring"), ((6, 7, 8), "Summer"), ((9, 10, 11), "Fall"))
# Day numbers follow Spark's dayofweek: Sunday = 1 ... Saturday = 7.  The
# reference marks days 6 and 7 (Friday, Saturday) as weekend; (1, 7) is the
# Saturday+Sunday alternative.
REFERENCE_WEEKEND_DAYS = (6, 7)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_local_time(date_str: str | Column, time_str: str | Column) -> Column:
    """``ymd_hm(paste(date, time))`` → TIMESTAMP_NTZ; malformed input gives null."""
    s = F.concat_ws(" ", _c(date_str), _c(time_str))
    return F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def intervention_flag(ts: str | Column, cut: str) -> Column:
    """``ts >= cut`` as a nullable boolean (null timestamp stays null)."""
    return _c(ts) >= F.lit(cut).cast("timestamp_ntz")


def hour_bucket_label(hour: str | Column, width: int = 2) -> Column:
    """Label like ``"0-1"`` … ``"22-23"`` for ``width``-hour buckets; null hour → null."""
    lo = F.floor(_c(hour) / width) * width
    return F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string"))


def season(month: str | Column) -> Column:
    """Season label from month number; months outside 1..12 and null give null."""
    m = _c(month)
    expr = None
    for months, name in SEASONS:
        cond = m.isin(*months)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def weekday_label(day_of_week: str | Column, weekend_days: Iterable[int] = REFERENCE_WEEKEND_DAYS) -> Column:
    """weekend / weekday label; null day gives null (R ``ifelse`` on NA)."""
    d = _c(day_of_week)
    return F.when(d.isNull(), F.lit(None).cast("string")) \
        .when(d.isin(*list(weekend_days)), F.lit(WEEKEND_LABEL)).otherwise(F.lit(WEEKDAY_LABEL))


def label_in(c: str | Column, members: Iterable, yes: str, no: str) -> Column:
    """Two-way label by set membership (roadside / night); null input gives null."""
    x = _c(c)
    return F.when(x.isNull(), F.lit(None).cast("string")) \
        .when(x.isin(*list(members)), F.lit(yes)).otherwise(F.lit(no))


def calendar_columns(local_ts: str | Column, weekend_days: Iterable[int] = REFERENCE_WEEKEND_DAYS) -> dict[str, Column]:
    """Calendar factor columns derived from a local-time TIMESTAMP_NTZ column."""
    t = _c(local_ts)
    hour = F.hour(t)
    dow = F.dayofweek(t)
    return {
        "time_of_day": hour,
        "day_of_week": dow,
        "weekend": weekday_label(dow, weekend_days),
        "month": F.month(t),
        "year": F.year(t),
        "time_of_day_cat": hour_bucket_label(hour),
    }
