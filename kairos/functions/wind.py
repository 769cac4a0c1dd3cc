"""Wind speed, meteorological direction and compass sector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight compass sectors, clockwise from North, 45° wide and
# centred on their bearing; North wraps around (>= 337.5 or < 22.5).
COMPASS_8 = ("North", "North-east", "East", "South-east", "South", "South-west", "West", "North-west")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def wind_speed(u: str | Column, v: str | Column) -> Column:
    return F.sqrt(_c(u) * _c(u) + _c(v) * _c(v))


def wind_direction(u: str | Column, v: str | Column) -> Column:
    """Direction the wind blows *from*, degrees in (0, 360]; calm gives 180."""
    return F.degrees(F.atan2(_c(u), _c(v))) + F.lit(180.0)


def compass_sector(direction: str | Column, labels: tuple[str, ...] = COMPASS_8) -> Column:
    """Sector label; sectors are centred on multiples of 360/len(labels).

    ``floor(((d + w/2) mod 360) / w)`` indexes the label list, so 337.5 and
    360 fall in North and 22.5 in North-east, as in the reference's case chain.
    Null or NaN direction gives null.
    """
    n = len(labels)
    w = 360.0 / n
    d = _c(direction)
    idx = F.floor(F.pmod(d + F.lit(w / 2.0), F.lit(360.0)) / F.lit(w)).cast("int")
    arr = F.array(*[F.lit(x) for x in labels])
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string")).otherwise(F.element_at(arr, idx + 1))
