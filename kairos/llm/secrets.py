"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger, a Parquet table that only grows, holds which rules (name@version)
have seen which blob and what they found.  A scan reads each unseen (blob, rule
version) pair once, whatever number of paths share the blob, appends to the
ledger, and findings are joined back to all paths.  Built-in functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairos.llm.common import configure, materialize
from kairos.session import checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group that is measured and its least length."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values.  The access and hex patterns ask for their least length within the
# match: a run of the class has at most one match there, so dropping short ones
# after matching gives the same.  The assign pattern must consume short values.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                      r"""([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

LEDGER = ("blob string, rules array<string>, "
          "spans array<struct<start: long, rank: int, kind: string, rule: string, end: long>>")


def new_ledger(spark: SparkSession) -> str:
    """Path of an empty ledger in the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _matches(rule: Rule, n: int) -> Column:
    """All matches of a rule in _t, with the text before each; only where the rule is due."""
    rx = F.lit(rule.pattern)
    found = F.regexp_extract_all("_t", rx, F.lit(0))
    return F.when(F.array_contains("_due", rule.key), F.struct(F.lit(n).alias("rank"), found.alias("m"))).otherwise(
        F.struct(F.lit(n).alias("rank"), F.array().cast("array<string>").alias("m")))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Scan the unseen (blob, rule version) pairs of ``docs``, append them to the ledger
    and return the paths: (id, blob), one row per row of ``docs``.

    Null texts count as empty.  Nothing is scanned twice: not equal texts within
    ``docs``, nor blobs that an earlier call has seen under the same rule version.
    """
    spark = docs.sparkSession
    configure(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_docs = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("_t"))
    paths = materialize(all_docs.select("id", "blob"))
    seen = spark.read.schema(LEDGER).parquet(ledger)
    every = F.array(*[F.lit(r.key) for r in rules])
    one = paths.groupBy("blob").agg(F.min("id").alias("rep"))
    known = seen.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("_seen"))
    due = one.join(known, "blob", "left").withColumn(
        "_due", F.when(F.col("_seen").isNull(), every).otherwise(F.array_except(every, F.col("_seen"))))
    due = materialize(due.where(F.size("_due") > 0).select(F.col("blob").alias("_blob"), "rep", "_due"))
    texts = all_docs.join(due, F.col("id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("_blob")))
    hits = (texts.select("blob", "_t", F.explode(F.filter(F.array(*[_matches(r, i) for i, r in enumerate(rules)]),
                                                          lambda x: F.size(x["m"]) > 0)).alias("_x"))
            .select("blob", "_t", "_x.rank", "_x.m"))
    between, measured = F.lit(None), F.lit(None)
    for i, r in enumerate(rules):
        mine = F.col("rank") == i
        between = F.when(mine, F.split("_t", r.pattern)).otherwise(between)
        measured = F.when(mine, F.regexp_extract_all("_t", F.lit(r.pattern), F.lit(r.group))).otherwise(measured)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rank") + 1)
    zipped = F.arrays_zip(F.transform("m", F.length).alias("len"), F.transform(between, F.length).alias("gap"),
                          F.transform(measured, F.length).alias("own"))
    each = (hits.select("blob", "rank", F.posexplode(zipped).alias("i", "x"))
            .select("blob", "rank", "i", "x.*").where("len is not null"))
    # repeated rows with one id and text are scanned together: keep one of each match
    each = each.groupBy("blob", "rank", "i").agg(F.first("len").alias("len"), F.first("gap").alias("gap"),
                                                 F.first("own").alias("own"))
    run = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ended = each.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(run))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    key = F.element_at(every, F.col("rank") + 1)
    spans = (ended.where(F.col("own") >= least)
             .select("blob", F.struct((F.col("end") - F.col("len")).alias("start"), "rank", kind.alias("kind"),
                                      key.alias("rule"), "end").alias("s"))
             .groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("spans")))
    none = F.array().cast("array<struct<start: long, rank: int, kind: string, rule: string, end: long>>")
    new = (due.select(F.col("_blob").alias("blob"), F.col("_due").alias("rules")).join(spans, "blob", "left")
           .select("blob", "rules", F.coalesce("spans", none).alias("spans")))
    new.write.mode("append").parquet(ledger)
    return paths


#: A blob of more than one in HOT paths is hot (so there are fewer than HOT); its paths are dealt over SALT tasks.
HOT, SALT = 1000, 64


def _to_paths(paths: DataFrame, told: DataFrame) -> DataFrame:
    """``paths`` with the columns of ``told``, which has one row per blob."""
    paths = materialize(paths)
    hot = F.broadcast(materialize(paths.groupBy("blob").count().where(F.col("count") > paths.count() / HOT)
                                  .select("blob", F.lit(SALT).alias("_n"))))
    dealt = (paths.join(hot, "blob", "left")
             .withColumn("_salt", F.coalesce(F.monotonically_increasing_id() % F.col("_n"), F.lit(0)).cast("long")).drop("_n"))
    copied = (told.join(hot, "blob", "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1).cast("array<long>")))
              .drop("_n"))
    return dealt.join(copied, ["blob", "_salt"]).drop("_salt")


def _known(spark: SparkSession, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found) per blob of the ledger.  Scans that overlap may append a blob twice; each span counts once."""
    current = F.array(*[F.lit(r.key) for r in rules])
    return (spark.read.schema(LEDGER).parquet(ledger)
            .select("blob", F.filter("spans", lambda s: F.array_contains(current, s["rule"])).alias("spans"))
            .groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found")))


def findings(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, blob, found) per path: found holds the spans of the given rule versions, by start, then rule."""
    return _to_paths(paths, _known(paths.sparkSession, ledger, rules))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per path: counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    base = F.array(*[F.lit(r.key) for r in rules if r.base])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    told = _known(paths.sparkSession, ledger, rules).select("blob", *[count(r.kind).alias(f"n_{r.kind}") for r in rules if r.base],
                        F.sha2(_joined(F.filter("found", lambda s: F.array_contains(base, s["rule"]))), 256)
                        .alias("base_sha256"), _joined(F.col("found")).alias("spans"))
    return _to_paths(paths, told)
