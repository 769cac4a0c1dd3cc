"""Mixing sources to target weights by Pareto order sampling.

Word targets per source come from cycling weights and a total that is a multiple
of all words; a source is never asked for more than ``MAX_COPIES`` times its
words, and the excess is reshared by weight until no target is above its limit.
Every document gets the whole copies that its source's target allows for
certain; the rest of the target is drawn with unequal probabilities, each
proportional to the document's words, such that the expected words are the rest.
Where that would pass 1 the document gets one more whole copy for certain and the
others share what is left.  The draw is a Pareto order sample: documents are
ranked by the odds of a per-document random number divided by the odds of their
inclusion probability, and the sample is the leading documents whose words come
nearest to the rest.  The random number is a hash of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Bits of the random number, and bits that one histogram level splits.
BITS, STEP = 52, 10
#: The cut is looked for row by row once its histogram bin holds at most this many rows.
FINE_ROWS = 5000
#: A plan of at most this many sources (under 10 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_bits(doc_id: Column, text: Column) -> Column:
    """52 uniform bits of the document's id, of its text where the id is null."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit("mix:"), named))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def ordinal(df: DataFrame, key: str) -> DataFrame:
    """``df`` (one row per key) with n = 0.. by key, nulls last, without a window over all rows."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = F.col(key).asc_nulls_last()
    placed = materialize(df.repartitionByRange(int(parts), order).withColumn("_p", F.spark_partition_id()))
    before = (placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_before", F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).drop("_c"))
    return (placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
            .join(before, "_p").withColumn("n", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target, whole, pi, rest) from rows (source, size).

    Only totals reach the driver, once per resharing round."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    by = materialize(ordinal(by, "source").withColumn("w", w).drop("n"))
    limit = F.lit(most) * F.col("source_size")
    total = share * (by.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        free = F.lit(True) if level is None else F.lit(level) * F.col("w") <= limit
        got = by.agg(F.sum(F.when(free, F.col("w"))), F.sum(F.when(~free, limit)),
                     F.sum(F.when(~free, 1))).first()
        new = (total - (got[1] or 0)) / got[0] if got[0] else 0.0
        if new == level or not got[0]:
            break
        level = new
    level = 0.0 if level is None else level
    target = F.least(F.lit(level) * F.col("w"), limit.cast("double"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (by.withColumn("target", target).withColumn("ratio", ratio)
            .withColumn("whole", F.floor("ratio").cast("long")).withColumn("pi", F.col("ratio") - F.col("whole"))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .select("source", "source_size", "target", "whole", "pi", "rest"))


def inclusion(lean: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with unit, edge and draw: a document of up to ``edge`` words is drawn with probability
    unit * words, a longer one is taken for certain, and ``draw`` is what the certain ones leave of the rest.

    Longer documents turn certain one length after another until the longest of the others has a
    probability below 1.  The window runs over the different lengths of a source, which the longest
    text bounds, whatever the number of documents."""
    lengths = (lean.where("size > 0").groupBy(F.col("source").alias("s"), "size").agg(F.count(F.lit(1)).alias("c"))
               .withColumn("w", F.col("c").cast("decimal(38,0)") * F.col("size")))
    open_ = plan.where("pi > 0").select(F.col("source").alias("s2"), "rest")
    longer = Window.partitionBy("s").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("s").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    steps = (lengths.join(open_, F.col("s").eqNullSafe(F.col("s2")))
             .withColumn("certain", F.coalesce(F.sum("w").over(longer), F.lit(0)).cast("double"))
             .withColumn("squares", F.sum(F.col("c").cast("double") * F.col("size") * F.col("size")).over(others))
             .withColumn("draw", F.col("rest") - F.col("certain"))
             .withColumn("unit", F.col("draw") / F.col("squares")))
    first = (steps.where("unit * size < 1").groupBy("s")
             .agg(F.max(F.struct(F.col("size").alias("edge"), "unit", "draw")).alias("x")))
    return plan.join(first.select("s", "x.*"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def pareto_rank(k: Column, pi: Column) -> Column:
    """Odds of the random number over odds of the inclusion probability."""
    u = (k + F.lit(0.5)) / F.lit(float(1 << BITS))
    return (u / (1 - u)) / (pi / (1 - pi))


def pareto_key(k: Column, pi: Column) -> Column:
    """The Pareto rank as a whole number of BITS bits: rank / (1 + rank), which keeps the order."""
    rank = pareto_rank(k, pi)
    return F.floor(rank / (1 + rank) * F.lit(float(1 << BITS))).cast("long")


def _drawn(size: Column) -> Column:
    """Whether a document takes part in the draw."""
    return (size > 0) & (size <= F.col("edge"))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cut, at_cut): documents whose Pareto key is below ``cut`` are in the sample, and the
    first ``at_cut`` of those that share it.

    The cut is found by sums per histogram bin of the key, one more level until the bin that holds
    it is small."""
    need = plan.where("unit > 0").select(F.col("source").alias("s"), F.col("draw").alias("rest"))
    odds = plan.where("unit > 0").select(F.col("source").alias("s"), "unit", "edge")
    rows = (rows.join(_bounded(odds), F.col("source").eqNullSafe(F.col("s"))).where(_drawn(F.col("size")))
            .select("s", "id", "size", pareto_key(F.col("k"), F.col("unit") * F.col("size")).alias("k")))
    base = need.withColumn("lo", F.lit(0).cast("long")).withColumn("acc", F.lit(0).cast("long"))
    level, span = 0, BITS
    while True:
        span = max(0, span - STEP)
        inside = rows if not level else rows.join(
            _bounded(base.select(F.col("s").alias("s2"), "lo")),
            F.col("s").eqNullSafe(F.col("s2")) & (F.shiftright("k", span + STEP) == F.shiftright("lo", span + STEP)))
        bins = (inside.groupBy("s", F.shiftright("k", span).alias("bin"))
                .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
        up_to = Window.partitionBy("s").orderBy("bin")
        found = (bins.withColumn("cum", F.sum("size").over(up_to))
                 .join(base.select(F.col("s").alias("s2"), "rest", "acc"), F.col("s").eqNullSafe(F.col("s2")))
                 .where("acc + cum >= rest")
                 .groupBy("s").agg(F.min(F.struct("bin", "cum", "size", "rows", "rest", "acc")).alias("b")))
        base = materialize(found.select("s", "b.rest", F.shiftleft("b.bin", span).alias("lo"),
                                        (F.col("b.acc") + F.col("b.cum") - F.col("b.size")).alias("acc"), "b.rows"))
        level += 1
        if span == 0 or (base.agg(F.max("rows")).first()[0] or 0) <= FINE_ROWS:
            break
    # the remaining bin of each source, row by row: the cut that comes nearest to the rest
    fine = rows.join(_bounded(base.select(F.col("s").alias("s2"), "lo", "rest", "acc")),
                     F.col("s").eqNullSafe(F.col("s2")) & (F.shiftright("k", span) == F.shiftright("lo", span)))
    run = Window.partitionBy("s").orderBy("k", F.col("id").asc_nulls_first(), "size").rowsBetween(
        Window.unboundedPreceding, 0)
    at = Window.partitionBy("s", "k").orderBy(F.col("id").asc_nulls_first(), "size")
    cum = (fine.withColumn("cum", F.col("acc") + F.sum("size").over(run))
           .withColumn("at_cut", F.row_number().over(at)))
    start = base.select("s", F.abs(F.col("acc") - F.col("rest")).alias("gap"), F.col("lo").alias("k"),
                        F.lit(0).alias("at_cut"))
    steps = cum.select("s", F.abs(F.col("cum") - F.col("rest")).alias("gap"), "k", "at_cut")
    return (start.unionByName(steps).groupBy("s").agg(F.min(F.struct("gap", "k", "at_cut")).alias("c"))
            .select(F.col("s").alias("source"), F.col("c.k").alias("cut"), F.col("c.at_cut").alias("at_cut")))


def _bounded(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def plan_mix(lean: DataFrame) -> DataFrame:
    """Per source: source_size, target, whole, pi, rest, unit, edge, draw, cut, at_cut; ``lean`` has id, source,
    size, k."""
    plan = materialize(inclusion(lean, materialize(targets(lean))))
    cuts = _cuts(lean, plan).withColumnRenamed("source", "s")
    return materialize(plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def assign(rows: DataFrame, plan: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``rows`` (columns _id, _source, _size, _k and ``names``) with copies, size, source_size, target."""
    drawn = F.coalesce(F.col("unit").isNotNull() & _drawn(F.col("_size")), F.lit(False))
    joined = (rows.join(_bounded(plan), F.col("_source").eqNullSafe(F.col("source")))
              .withColumn("_rank", F.when(drawn, pareto_key(F.col("_k"), F.col("unit") * F.col("_size")))))
    tie = F.row_number().over(Window.partitionBy("_source", "_rank").orderBy(F.col("_id").asc_nulls_first(), "_size"))
    more = F.coalesce((F.col("_size") > F.col("edge")) | (F.col("_rank") < F.col("cut")), F.lit(False))
    out = [*names, F.col("_size").alias("size"), "source_size", "target"]
    at = F.coalesce(F.col("_rank") == F.col("cut"), F.lit(False))
    rest = joined.where(~at).withColumn("copies", F.col("whole") + more.cast("long"))
    edge = joined.where(at).withColumn("copies", F.col("whole") + (tie <= F.col("at_cut")).cast("long"))
    return rest.select(*out, "copies").unionByName(edge.select(*out, "copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies) for every row of ``docs``.

    Null texts have size 0, a null source is a source of its own (ordered last),
    a row without an id takes its random number from its text.  Repeated rows are
    ranked one after another.  Documents without words get the whole copies of their source and
    never change its words.  An empty table gives no rows.
    """
    configure(docs.sparkSession)
    lean = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"), random_bits(F.col(id_col), F.col(text_col)).alias("k")))
    plan = plan_mix(lean)
    rows = lean.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
                       F.col("k").alias("_k"))
    return assign(rows, plan, ("_id",)).withColumnRenamed("_id", "id")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of ``docs``."""
    configure(docs.sparkSession)
    lean = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"), random_bits(F.col(id_col), F.col(text_col)).alias("k")))
    plan = plan_mix(lean)
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                        word_count(F.col(text_col)).alias("_size"), random_bits(F.col(id_col), F.col(text_col)).alias("_k"))
    taken = assign(whole, plan, ("_row",))
    return (taken.where("copies > 0")
            .select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("_row.*"))
