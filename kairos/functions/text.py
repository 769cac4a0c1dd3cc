"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def pad_left(c, width: int, fill: str = "0") -> Column:
    """Pad to ``width``; a longer text stays whole (``lpad`` would cut it)."""
    x = _c(c)
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, fill))


def substr_range(c, start: int, stop: int) -> Column:
    """1-based inclusive ``substr(x, start, stop)``."""
    return F.substring(_c(c), start, stop - start + 1)


def str_sub(c, start: int, end: int) -> Column:
    """``str_sub`` with 1-based ``start`` and a negative ``end`` counted from the right."""
    x = _c(c)
    if end >= 0:
        return F.substring(x, start, end - start + 1)
    length = F.length(x) + F.lit(end + 1) - F.lit(start) + F.lit(1)
    return x.substr(F.lit(start), F.greatest(length, F.lit(0)))


def composite_key(entity, ts) -> Column:
    """``entity_yyyy-MM-dd HH:mm:ss`` key, kept only for parity; joins use the two columns."""
    return F.concat_ws("_", _c(entity), F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"))
