"""Panel construction, joins, dedup and reshape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairos.session import materialize

#: A per-group table of at most so many rows (some tens of MB) is broadcast.
BROADCAST_GROUPS = 100_000


def hour_floor(ts: str | Column) -> Column:
    """Truncate to the hour, staying TIMESTAMP_NTZ (``date_trunc`` returns TIMESTAMP)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def time_grid(entities: DataFrame, entity_cols: Sequence[str], t0: str, t1: str, step_hours: int = 1,
              block_hours: int = 24 * 7, ts_col: str = "ts") -> DataFrame:
    """Entity × regular time grid, inclusive of both ends.

    Generated, never joined: each entity row explodes into time blocks, the
    (small) block rows are spread over the cluster, and each block explodes
    into its steps.  With six entities and a multi-year hourly grid this keeps
    generation parallel instead of six long single-task explodes.
    """
    lo = F.lit(t0).cast("timestamp_ntz")
    hi = F.lit(t1).cast("timestamp_ntz")
    blk = F.expr(f"make_dt_interval(0, {block_hours})")
    step = F.expr(f"make_dt_interval(0, {step_hours})")
    blocks = (entities.select(*entity_cols).distinct()
              .withColumn("_blk", F.explode(F.sequence(lo, hi, blk))))
    blocks = blocks.repartition(*entity_cols, "_blk")
    last = F.least(F.col("_blk") + blk - step, hi)
    return (blocks.withColumn(ts_col, F.explode(F.sequence(F.col("_blk"), last, step)))
                  .drop("_blk"))


def complete_panel(obs: DataFrame, entity_cols: Sequence[str], ts_col: str, t0: str, t1: str,
                   entities: DataFrame | None = None, step_hours: int = 1) -> DataFrame:
    """Left join observations onto the full grid; absent cells become null.

    ``obs`` must hold at most one row per (entity, ts) (aggregate first).  The
    join is an equi-join on the composite key, so a hot entity is spread over
    tasks by its timestamps; AQE picks broadcast when the observed side is small.
    """
    ents = entities if entities is not None else obs.select(*entity_cols)
    grid = time_grid(ents, entity_cols, t0, t1, step_hours, ts_col=ts_col)
    return grid.join(obs, [*entity_cols, ts_col], "left")


def left_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Sequence[str],
              null_safe: bool = False) -> DataFrame:
    """Left equi-join, optionally null-safe (dplyr matches NA to NA).

    ``on`` is a list of column names or (left, right) pairs; right-side key
    columns are dropped.  No broadcast hint: Catalyst's size estimate and AQE's
    runtime threshold broadcast the right side only when it is proven small.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in {p[1] for p in pairs} else F.col(c) for c in right.columns])
    conds = [(F.col(lk).eqNullSafe(F.col(f"_r_{rk}")) if null_safe else F.col(lk) == F.col(f"_r_{rk}"))
             for lk, rk in pairs]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{rk}" for _, rk in pairs])


def join_groups(df: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows joined to a per-group table (one row per key), null keys included.

    The table is written once and counted: up to BROADCAST_GROUPS rows it is
    broadcast, so raw rows of a hot group never move; a longer one is joined by
    shuffle, where AQE splits hot keys."""
    small = materialize(groups)
    return left_join(df, F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small, list(on), null_safe=True)


def priority_union(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All primary rows plus fallback rows whose key the primary lacks.

    A null key matches a null key, as ``%in%`` has it.
    """
    have = primary.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    extra = fallback.join(have, same, "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def semi_count(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of ``a`` have their key in ``b`` (and how many do not)."""
    bk = b.select(*keys).distinct()
    return (a.join(bk.withColumn("_hit", F.lit(True)), list(keys), "left")
             .agg(F.count_if(F.col("_hit").isNotNull()).alias("n_in"),
                  F.count_if(F.col("_hit").isNull()).alias("n_out")))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their multiplicity.

    A partial-aggregated count, so a hot key never lands whole in one task;
    each duplicated key is reported once with ``n_rows``.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1))


def pivot_longer(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
                 names_to: Sequence[str] = ("variable",), sep: str | None = None,
                 value_name: str = "value") -> DataFrame:
    """Unpivot; with ``sep`` the column name is split into ``names_to`` parts.

    Splitting is on the *last* separator so names like ``spf_humidity_mean``
    give (``spf_humidity``, ``mean``).
    """
    long = df.unpivot(list(id_cols), list(value_cols), "_name", value_name)
    if sep is None:
        return long.withColumnRenamed("_name", names_to[0])
    a, b = names_to
    cut = f"(length(_name) - locate('{sep}', reverse(_name)) + 1)"
    return (long.withColumn(a, F.expr(f"substring(_name, 1, {cut} - 1)"))
                .withColumn(b, F.expr(f"substring(_name, {cut} + 1)"))
                .drop("_name"))


def lookup_join(df: DataFrame, source: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``df`` with ``values`` looked up by ``key`` in the distinct (key, values) rows of ``source``.

    A key that ``source`` lacks gives nulls, one with several values as many rows; a null key finds nothing."""
    return df.join(source.select(key, *values).distinct(), key, "left")
