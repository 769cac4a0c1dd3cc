"""Design matrix and per-(stratum, entity) Gram aggregate (§4.3).

The only full-data pass of every model.  Spark builds typed design columns
(centred/scaled numerics, 0/1 flags, factor level indexes) in codegen; each
partition then folds its rows into one small A'A matrix per key with numpy
(``mapInPandas``), and a grouped sum combines partitions.  Output size is
keys × (p+1)(p+2)/2, independent of row count, and no key is ever gathered
whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairos.session import materialize

INTERCEPT = "(Intercept)"
#: Most levels of a factor that are looked up; more are an error, as each is a column of the model.
MOST_LEVELS = 1000
#: Bytes of per-entity matrices that a task holds before it hands them on.
HELD_BYTES = 64 << 20


@dataclass
class ModelSpec:
    """``outcome ~ slopes + flags + numeric + factors``, random ``1 + slopes | group``.

    * ``flags`` / ``slopes``: 0/1 or boolean terms, never centred (a random
      slope column must keep its meaning).
    * ``numeric``: centred and scaled internally for conditioning; results are
      reported on the original scale.
    * ``factors``: name → ordered levels; the first level is the reference
      (treatment contrasts).  ``None`` derives sorted distinct levels.
    * ``group``: random-effect grouping column; ``None`` fits OLS.
    * ``strata``: one independent fit per stratum value.
    """

    outcome: str
    numeric: Sequence[str] = ()
    flags: Sequence[str] = ()
    factors: dict = field(default_factory=dict)
    group: str | None = None
    slopes: Sequence[str] = ()
    strata: Sequence[str] = ()
    method: str = "ML"
    scale: bool = True

    def q(self) -> int:
        return 0 if self.group is None else 1 + len(self.slopes)


@dataclass
class Design:
    spec: ModelSpec
    terms: list            # X column names, intercept first, then slopes
    levels: dict           # factor → level list
    moments: dict          # numeric → (mean, sd) used for scaling
    dropped: list          # numeric columns dropped for zero variance


def resolve_design(df: DataFrame, spec: ModelSpec) -> Design:
    """Fix level lists, scaling moments and term order once for all strata.

    One small aggregate: per numeric column mean and sd, per unlisted factor
    its sorted distinct levels (bounded by the model's width).
    """
    aggs = []
    for c in spec.numeric:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m__{c}"), F.stddev_samp(F.col(c).cast("double")).alias(f"s__{c}")]
    need = [f for f, lv in spec.factors.items() if lv is None]
    if need:        # counted first (a bounded sketch): the levels of a wide column are never collected
        many = df.agg(*[F.approx_count_distinct(F.col(f).cast("string")).alias(f) for f in need]).first()
        wide = [f for f in need if many[f] > MOST_LEVELS]
        if wide:
            raise ValueError(f"more than {MOST_LEVELS} levels in {wide}: list them, or take them as strata or group")
    for f in need:
        aggs.append(F.sort_array(F.collect_set(F.col(f).cast("string"))).alias(f"l__{f}"))
    row = df.agg(*aggs).first() if aggs else None
    moments, dropped = {}, []
    for c in spec.numeric:
        m, s = row[f"m__{c}"], row[f"s__{c}"]
        if s is None or not s > 0:
            dropped.append(c)
        elif spec.scale:
            moments[c] = (float(m), float(s))
        else:
            moments[c] = (0.0, 1.0)
    levels = {f: ([str(x) for x in lv] if lv is not None else list(row[f"l__{f}"])) for f, lv in spec.factors.items()}
    terms = [INTERCEPT, *spec.slopes, *[f for f in spec.flags if f not in spec.slopes],
             *[c for c in spec.numeric if c in moments]]
    for f, lv in levels.items():
        terms += [f"{f}{lv_}" for lv_ in lv[1:]]
    return Design(spec, terms, levels, moments, dropped)


def model_frame(df: DataFrame, design: Design) -> DataFrame:
    """Complete-case typed columns for the Gram pass (all Spark expressions)."""
    spec = design.spec
    cols = [spec.outcome, *spec.slopes, *spec.flags, *spec.numeric, *spec.factors, *spec.strata]
    if spec.group:
        cols.append(spec.group)
    base = df.select(*dict.fromkeys(cols)).na.drop(how="any")
    sk = F.concat_ws("|", *[F.col(s).cast("string") for s in spec.strata]) if spec.strata else F.lit("all")
    ek = F.col(spec.group).cast("string") if spec.group else F.lit("all")
    out = [sk.alias("_stratum"), ek.alias("_entity"), F.col(spec.outcome).cast("double").alias("_y")]
    xs = []
    for t in [*spec.slopes, *[f for f in spec.flags if f not in spec.slopes]]:
        xs.append(F.col(t).cast("double").alias(f"x__{t}"))
    for c, (m, s) in design.moments.items():
        xs.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"x__{c}"))
    for f, lv in design.levels.items():
        arr = F.array(*[F.lit(v) for v in lv])
        xs.append(F.array_position(arr, F.col(f).cast("string")).cast("int").alias(f"f__{f}"))
    frame = base.select(*out, *xs)
    # a value outside the given levels is missing (R: NA), never the reference level
    for f in design.levels:
        frame = frame.where(F.col(f"f__{f}") > 0)
    return frame


def _n_cols(design: Design) -> int:
    return len(design.terms) + 1  # + outcome


def gram_table(df: DataFrame, design: Design, checkpoint: bool = True) -> DataFrame:
    """Per-(stratum, entity) Gram of A = [X y]: rows (_stratum, _entity, n, g).

    ``g`` is the row-major upper triangle of A'A (length m(m+1)/2, m = p+1).
    """
    mf = model_frame(df, design)
    num = [c for c in mf.columns if c.startswith("x__")]
    fac = [(c, len(design.levels[c[3:]])) for c in mf.columns if c.startswith("f__")]
    m = _n_cols(design)
    iu = np.triu_indices(m)
    n_flag_num = len(num)

    def sums(acc: dict) -> pd.DataFrame:
        tri = len(iu[0])
        return pd.DataFrame({"_stratum": [s for s, _ in acc for _ in range(tri)],
                             "_entity": [e for _, e in acc for _ in range(tri)],
                             "k": np.tile(np.arange(tri, dtype=np.int32), len(acc)),
                             "v": np.concatenate([G[iu] for G in acc.values()])})

    def matrix(sub: pd.DataFrame) -> np.ndarray:
        """[1, numbers, levels, y] of some rows."""
        A = np.zeros((len(sub), m))
        A[:, 0] = 1.0
        j = 1
        if n_flag_num:
            A[:, 1:1 + n_flag_num] = sub[num].to_numpy(dtype=np.float64)
            j += n_flag_num
        for c, nl in fac:
            idx = sub[c].to_numpy().astype(np.int64)
            rows = np.nonzero(idx >= 2)[0]
            A[rows, j + idx[rows] - 2] = 1.0
            j += nl - 1
        A[:, m - 1] = sub["_y"].to_numpy(dtype=np.float64)
        return A

    def few_rows_per_key(pdf: pd.DataFrame) -> bool:
        return m <= 16 and pdf[["_stratum", "_entity"]].drop_duplicates().shape[0] * 64 > len(pdf) > 64

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            if len(acc) * m * m * 8 > HELD_BYTES:      # partial sums add up: hand them on and start anew
                yield sums(acc)
                acc = {}
            if few_rows_per_key(pdf):
                key, names = pd.factorize(pd.MultiIndex.from_frame(pdf[["_stratum", "_entity"]]))
                order = np.argsort(key, kind="stable")
                A, starts = matrix(pdf.iloc[order]), np.flatnonzero(np.diff(key[order], prepend=-1))
                # products of one row at a time, added up per key, in blocks of bounded size
                block = max(1, HELD_BYTES // (8 * m * m))
                for s in range(0, len(A), block):
                    part = A[s:s + block]
                    at = np.unique(np.r_[0, starts[(starts > s) & (starts < s + block)] - s])
                    sums_ = np.add.reduceat(part[:, iu[0]] * part[:, iu[1]], at, axis=0)
                    for k, v in zip(key[order][s + at], sums_):
                        name = names[k]
                        acc[name] = acc[name] + unpack(v, m) if name in acc else unpack(v, m)
                    if len(acc) * m * m * 8 > HELD_BYTES:
                        yield sums(acc)
                        acc = {}
                continue
            for (sk, ek), sub in pdf.groupby(["_stratum", "_entity"], sort=False):
                A = matrix(sub)
                G = A.T @ A
                key = (sk, ek)
                if key in acc:
                    acc[key] += G
                else:
                    acc[key] = G
        if acc:
            yield sums(acc)

    schema = "_stratum string, _entity string, k int, v double"
    long = mf.mapInPandas(partial, schema).groupBy("_stratum", "_entity", "k").agg(F.sum("v").alias("v"))
    g = (long.groupBy("_stratum", "_entity")
             .agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("_kv"))
             .select("_stratum", "_entity", F.col("_kv.v").alias("g")))
    g = g.withColumn("n", F.col("g")[0])
    return materialize(g) if checkpoint else g


def unpack(g: np.ndarray, m: int) -> np.ndarray:
    """Upper-triangle vector → symmetric m×m matrix."""
    G = np.zeros((m, m))
    iu = np.triu_indices(m)
    G[iu] = g
    G = G + np.triu(G, 1).T
    return G


def stratum_totals(gram: DataFrame, m: int) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """Σ over entities of each stratum's Gram (strata × m(m+1)/2 numbers) and
    the entity count per stratum, in one small aggregate."""
    tot = (gram.select("_stratum", F.posexplode("g").alias("k", "v"))
               .groupBy("_stratum", "k").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("e")).collect())
    out: dict = {}
    ents: dict = {}
    tri = m * (m + 1) // 2
    for r in tot:
        out.setdefault(r["_stratum"], np.zeros(tri))[r["k"]] = r["v"]
        ents[r["_stratum"]] = int(r["e"])
    return {s: unpack(v, m) for s, v in out.items()}, ents

