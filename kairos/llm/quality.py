"""Quality rules: base limits and robust multivariate outliers, per language and source.

Statistics of every text are transformed to four roughly normal numbers.  Within
each (language, source) group a minimum-covariance-determinant estimate is found
by concentration steps: mean and covariance of the kept part, Mahalanobis
distances of all rows, the nearest half kept for the next step.  Three fixed starts
(median deviations, covariance of hyperbolic tangents, spatial signs) take a few
steps each; the start whose half has the least determinant goes on until the
determinant stands, and rows near that estimate give the final one.  As starts and
core rest on half of a group, junk may be nearly the other half.  Rows far from the estimate are rejected.  Everything is grouped sums and small joins:
order statistics come from histograms of fixed bins, so no group is ever sorted
or gathered, and a group that holds a third of all rows costs what its rows cost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import WS, configure, materialize

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Share of a group that the estimate rests on, and concentration steps of every start.
CORE = 0.5
TRIAL = 2
#: An estimate stands when a step lowers its determinant by less than this share.
STANDS = 1e-3
#: Squared distances above this are rejected: the 1 - 1e-6 quantile of chi-square with 4 degrees.
CUT = 33.4
#: Rows up to this, the 0.975 quantile, give the final estimate.
NEAR = 11.14
#: Groups with fewer rows that pass the base limits are estimated from their language's rows, and those
#: of small languages from all rows.
MIN_GROUP = 40
#: Least spread of each transformed statistic, in its own unit.
FEATURES = ("x1", "x2", "x3", "x4")
FLOOR = (0.05, 0.05, 0.10, 0.10)
#: Histogram bins per doubling of the squared distance.
FINE = 16
#: Bins per unit of a transformed statistic, for the starting medians.
START_BINS = 200


def _at(a: str, i: str) -> str:
    return f"get({a}, {i})"


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null texts count as empty.  Windows are compared by a 64-bit hash of their
    three words; positions of equal hashes meet by sorting, so the work per text
    is n log n however repetitive it is."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    d = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.withColumn("_s", F.split("_t", WS))
    d = d.withColumn("_w", F.expr("slice(_s, if(_s[0] = '', 2, 1), greatest(0, size(_s) "
                                  "- if(_s[0] = '', 1, 0) - if(size(_s) > 1 and element_at(_s, -1) = '', 1, 0)))"))
    d = d.withColumn("_h", F.expr(
        "if(size(_w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 3), "
        "i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))))"))
    # 40 bits of hash and 24 of position: equal windows become neighbours, then whole hashes decide
    d = d.withColumn("_k", F.expr("sort_array(transform(_h, (h, i) -> ((h >> 24) << 24) | (i & 16777215)))"))
    d = d.withColumn("_c", F.expr(
        "filter(_k, (k, i) -> (k >> 24) <=> (get(_k, i + 1) >> 24) or (k >> 24) <=> (get(_k, i - 1) >> 24))"))
    d = d.withColumn("_m", F.expr(
        "if(size(_h) > 16777216, "
        "sort_array(transform(_h, (h, i) -> struct(h as h, cast(i as bigint) as p))), "
        "sort_array(transform(_c, k -> struct(get(_h, cast(k & 16777215 as int)) as h, k & 16777215 as p))))"))
    d = d.withColumn("_p", F.expr(
        "sort_array(transform(filter(_m, (m, i) -> m.h <=> get(_m, i + 1).h or m.h <=> get(_m, i - 1).h), m -> m.p))"))
    lines = "filter(split(_t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    d = d.withColumn("_l", F.expr(lines))
    plain = F.col("_t")
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    return d.select(
        *others, F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.octet_length("_t") - F.octet_length(plain)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(_p, (p, i) -> least(3, coalesce(get(_p, i + 1) - p, 3))), 0L, (a, x) -> a + x)")
        .cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def transformed() -> list[Column]:
    """Log word length and variance-stabilised shares of symbols, repeated lines and repeated words.

    Shares are drawn in by a few made-up words, so that short texts don't stand out by chance."""
    share = lambda x, n: F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(x) + 0.5) / (F.col(n) + 50.0))))
    length = F.log((F.col("word_chars") + 250.0) / (F.col("n_words") + 50.0))
    return [length.alias("x1"), share("n_symbols", "word_chars").alias("x2"),
            share("n_dup_lines", "n_words").alias("x3"), share("n_repeat_words", "n_words").alias("x4")]


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _moments(rows: DataFrame) -> DataFrame:
    """Mean, covariance (floored), its Cholesky factor and determinant per group and start, as columns."""
    agg = [F.count(F.lit(1)).alias("n")]
    agg += [F.sum(x).alias(f"s_{x}") for x in FEATURES]
    agg += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in _PAIRS]
    m = rows.groupBy("g", "st").agg(*agg)
    m = m.select("g", "st", *[(F.col(f"s_{x}") / F.col("n")).alias(f"m{i}") for i, x in enumerate(FEATURES)],
                 *[(F.col(f"q{i}{j}") / F.col("n") - F.col(f"s_{FEATURES[i]}") * F.col(f"s_{FEATURES[j]}")
                    / (F.col("n") * F.col("n"))).alias(f"v{i}{j}") for i, j in _PAIRS])
    return _cholesky(m)


def _cholesky(m: DataFrame) -> DataFrame:
    means = [f"m{i}" for i in range(len(FEATURES))]
    det = F.lit(1.0)
    for i, j in _PAIRS:
        e = F.col(f"v{i}{j}")
        for k in range(j):
            e = e - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        if i == j:
            e = F.sqrt(F.greatest(e, F.lit(0.0)) + FLOOR[i] ** 2)
            det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
        else:
            e = e / F.col(f"l{j}{j}")
        m = m.withColumn(f"l{i}{j}", e)
    return m.select("g", "st", *means, *[f"l{i}{j}" for i, j in _PAIRS], det.alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        e = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            e = e - F.col(f"l{i}{k}") * z[k]
        z.append(e / F.col(f"l{i}{i}"))
    out = z[0] * z[0]
    for e in z[1:]:
        out = out + e * e
    return out


def _bin(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-6) * FINE).cast("int")


def _quantile_bin(rows: DataFrame, bins: Column, share: float, name: str) -> DataFrame:
    """(g, st, name): least bin up to which the share of the group's rows lies."""
    counts = rows.groupBy("g", "st", bins.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    key = Window.partitionBy("g", "st")
    cum = counts.withColumn("up", F.sum("c").over(key.orderBy("b"))).withColumn("n", F.sum("c").over(key))
    return cum.where(F.col("up") >= F.lit(share) * F.col("n")).groupBy("g", "st").agg(F.min("b").alias(name))


#: Median of chi-square with 4 degrees of freedom: distances are scaled so that each group's median is this.
_MEDIAN = 3.357
#: The same of the rows up to NEAR.
_NEAR_MEDIAN = 3.277


#: Estimates of at most so many groups (under 20 MB) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 50_000


def _middle(counts: DataFrame, value: str, name: str) -> DataFrame:
    """(g, f, name): median of ``value`` weighted by the count c."""
    key = Window.partitionBy("g", "f")
    cum = counts.withColumn("up", F.sum("c").over(key.orderBy(value))).withColumn("n", F.sum("c").over(key))
    return cum.where(2 * F.col("up") >= F.col("n")).groupBy("g", "f").agg(F.min(value).alias(name))


def _scaled(fit: DataFrame, near: DataFrame, median: float) -> DataFrame:
    """``fit`` with the scale that moves the median distance of its rows to ``median``."""
    mid = _quantile_bin(near.withColumn("d", _distance()), _bin(F.col("d")), 0.5, "mid")
    # the core's covariance is too small; the floor already widens groups without spread
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 1.0) / FINE) / median)
    return fit.join(mid, ["g", "st"]).withColumn("scale", scale).drop("mid")


def _starts(rows: DataFrame, near_by) -> DataFrame:
    """Three estimates per group, st = 0, 1, 2, all about the medians.

    One histogram of all features gives medians m and median deviations s; one more pass over
    z = (x - m) / s gives the sums of tanh(z) tanh(z)' and of z z' / |z|^2, each scaled back by s."""
    long = rows.select("g", F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.floor(F.col(x) * START_BINS).cast("int").alias("b"))
        for i, x in enumerate(FEATURES)])).alias("x")).select("g", "x.*")
    counts = materialize(long.groupBy("g", "f", "b").agg(F.count(F.lit(1)).alias("c")))
    mid = _middle(counts, "b", "m")
    off = counts.join(near_by(mid), ["g", "f"]).withColumn("d", F.abs(F.col("b") - F.col("m")))
    marks = mid.join(_middle(off, "d", "s"), ["g", "f"])
    of = lambda i, e: F.max(F.when(F.col("f") == i, e))
    spread = F.col("s") / START_BINS * 1.4826
    width = range(len(FEATURES))
    centre = materialize(marks.groupBy("g").agg(*[of(i, (F.col("m") + 0.5) / START_BINS).alias(f"m{i}") for i in width],
                                                *[of(i, spread).alias(f"s{i}") for i in width]))
    z = rows.join(near_by(centre), "g").select("g", *[
        ((F.col(x) - F.col(f"m{i}")) / F.greatest(F.col(f"s{i}"), F.lit(FLOOR[i]))).alias(f"z{i}")
        for i, x in enumerate(FEATURES)])
    far = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in width), F.lit(0.0)), F.lit(1e-12))
    sums = z.withColumn("far", far).groupBy("g").agg(
        *[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"h{i}{j}") for i, j in _PAIRS],
        *[(len(FEATURES) * F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("far"))).alias(f"p{i}{j}") for i, j in _PAIRS])
    wide = centre.join(sums, "g")
    scale = lambda i: F.greatest(F.col(f"s{i}"), F.lit(FLOOR[i]))
    first = [(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS]
    scaled = lambda c: [(F.col(f"{c}{i}{j}") * scale(i) * scale(j)).alias(f"v{i}{j}") for i, j in _PAIRS]
    each = F.array(*[F.struct(F.lit(n).alias("st"), *v) for n, v in enumerate((first, scaled("h"), scaled("p")))])
    return _cholesky(wide.select("g", *[f"m{i}" for i in width], F.explode(each).alias("e"))
                     .select("g", *[f"m{i}" for i in width], "e.*"))


def _step(rows: DataFrame, fit: DataFrame, near_by) -> DataFrame:
    """One concentration step of every estimate in ``fit``: moments of the half that is nearest to it."""
    limit = _quantile_bin(rows.join(near_by(fit), "g").withColumn("d", _distance()), _bin(F.col("d")), CORE, "limit")
    core = rows.join(near_by(fit.join(limit, ["g", "st"])), "g").where(_bin(_distance()) <= F.col("limit"))
    return materialize(_moments(core.select("g", "st", *FEATURES)))


def least_determinant(rows: DataFrame, near_by=lambda df: df) -> DataFrame:
    """(g, st, mean and factor columns, det): the standing estimate of least determinant per group.

    Every start takes TRIAL steps, then the best of each group goes on.  A group is done when a step
    doesn't lower its determinant by STANDS any more, so no group takes a fixed number of steps;
    determinants have a floor, so all come to an end.  The driver reads one flag per step."""
    fit = materialize(_starts(rows, near_by))
    for _ in range(TRIAL):
        fit = _step(rows, fit, near_by)
    best = fit.groupBy("g").agg(F.min(F.struct("det", "st")).alias("b")).select("g", "b.st")
    fit = materialize(fit.join(best, ["g", "st"]))
    done = []
    while True:
        new = _step(rows, fit, near_by)
        before = fit.select("g", F.col("det").alias("old"))
        falls = materialize(new.join(before, "g").withColumn("falls", F.col("det") < F.col("old") * (1 - STANDS)))
        done.append(fit.join(falls.where("not falls").select("g"), "g", "left_semi"))
        fit = materialize(falls.where("falls").drop("old", "falls"))
        if fit.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return materialize(out)


def robust_distance(rows: DataFrame, few: bool) -> DataFrame:
    """(g, mean and factor columns, scale) per group of ``rows`` (g, x1..x4).

    ``few``: the groups are no more than BROADCAST_GROUPS."""
    near_by = F.broadcast if few else (lambda df: df)
    rows = materialize(rows.select("g", *FEATURES))
    fit = least_determinant(rows, near_by)
    fit = materialize(_scaled(fit, rows.join(near_by(fit), "g"), _MEDIAN))
    near = materialize(rows.join(near_by(fit), "g").where(_distance() / F.col("scale") <= NEAR)
                       .select("g", "st", *FEATURES))
    fit = materialize(_moments(near))
    return materialize(_scaled(fit, near.drop("st").join(near_by(fit), "g"), _NEAR_MEDIAN).drop("st", "det"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the text, with the statistics, base_failed, distance and kept
    (columns of these names are replaced).

    A row is kept if it passes the base limits and its scaled squared distance
    is at most CUT.  Null languages and sources are groups of their own; repeated
    rows are judged alike; an empty table gives no rows.  Rows that fail the base
    limits don't shape the estimates.  A covariance of four numbers needs rows: a
    (language, source) group with fewer than MIN_GROUP that pass the base limits is
    judged by the estimate of its language's rows, and where the language has fewer
    too by that of all rows.
    """
    spark = docs.sparkSession
    configure(spark)
    names = [c for c in docs.columns if c not in (text_col, *_OUT[1:], "distance", "kept")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(lang_col).alias("_lang"),
                         F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    stats = statistics(packed, "_text").withColumn("base_failed", base_failed())
    stats = materialize(stats.select("*", *transformed()))
    ok = stats.where("not base_failed")
    # small groups borrow the rows of their language, small languages all rows
    by = ok.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    lang_n = by.groupBy("_lang").agg(F.sum("n").alias("n_lang"))
    part = F.when(F.col("n") >= MIN_GROUP, F.to_json(F.array(_text("_l"), _text("_source"))))
    lang = F.when(F.col("n_lang") >= MIN_GROUP, F.to_json(F.array(_text("_l"))))
    group = materialize(
        by.withColumnRenamed("_lang", "_l").join(lang_n, F.col("_l").eqNullSafe(F.col("_lang"))).drop("_lang")
        .select("_l", F.col("_source").alias("_s"), F.coalesce(part, lang, F.lit("*")).alias("g")))
    few = group.count() <= BROADCAST_GROUPS
    near_by = F.broadcast if few else (lambda df: df)
    named = materialize(ok.join(near_by(group), F.col("_lang").eqNullSafe(F.col("_l"))
                                & F.col("_source").eqNullSafe(F.col("_s"))).drop("_l", "_s"))
    wide = group.where(~F.col("g").contains(",")).select("g").distinct()
    small = [r.g for r in wide.limit(1).collect()]
    rows = named.select("g", *FEATURES) if not small else _with_wide(named, wide)
    fit = robust_distance(rows, few)
    judged = (named.join(near_by(fit), "g").withColumn("distance", _distance() / F.col("scale"))
              .select(*_OUT, F.col("distance"), (F.col("distance") <= CUT).alias("kept")))
    failed = stats.where("base_failed").select(*_OUT, F.lit(None).cast("double").alias("distance"),
                                               F.lit(False).alias("kept"))
    return judged.unionByName(failed).select(*[F.col(f"_row.`{c}`") for c in names], *_OUT[1:],
                                                  "distance", "kept")


_OUT = ["_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _text(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def _with_wide(named: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows of each group, and for wide groups (a language, or *) the rows of all that they stand for."""
    own = named.where(F.col("g").contains(",")).select("g", *FEATURES)
    keys = F.explode(F.array(F.to_json(F.array(_text("_lang"))), F.lit("*")))
    more = named.select(keys.alias("g"), *FEATURES).join(F.broadcast(wide) if wide.count() < 10_000 else wide, "g",
                                                         "left_semi")
    return own.unionByName(more)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """The kept rows of ``docs`` with all columns.  Rows are matched by content, so nothing hangs on an id."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(F.struct("*").alias("_row"), key.alias("_key"), F.col(text_col).alias("_t"),
                         F.col(lang_col).alias("_g"), F.col(source_col).alias("_f"))
    bad = judge(tagged.drop("_row"), "_t", "_g", "_f").where("not kept").select("_key").distinct()
    return tagged.select("_row", "_key").join(bad, "_key", "left_anti").select("_row.*")
