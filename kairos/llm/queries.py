"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairos.llm import (decontaminate, lines, lm, mixing, periodic, phrases, quality, secrets, sharding, simhash,
                        tokens, warc, wrapper)
from kairos.llm.common import table


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the WARC files that its ARC record became."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrapper.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                                      table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    d = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id")


def op5_blob_ledger_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned once per distinct text into a fresh ledger."""
    ledger = secrets.new_ledger(spark)
    paths = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"), ledger)
    return secrets.digest(paths, ledger).select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                                                "base_sha256", "spans")


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with the line that is kept of its component."""
    d = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select(F.col("id").alias("doc_id"), "line_no", F.col("keep_id").alias("keep_doc_id"), "keep_line", "kept")


def op7_slot_table_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents", "doc_id"))


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance")


def op9_bloom_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base score and model score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    scored = lm.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), lm.held_out(F.col("id")).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    d = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies")


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which one in ten repeats some of its words up to its end.

    h is the CRC-32 of the decimal id (a null id is never chosen) and g = h // 10; a chosen text
    of n words takes up word a + (i - a) % p in every place i from a on, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), its words joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    chosen = (docs.where(hit).select("doc_id", "text", F.floor(h / 10).alias("g"), w.alias("w"))
              .withColumn("n", F.size("w").cast("long")).withColumn("a", F.expr("g % nullif(n, 0)"))
              .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
              .withColumn("text", F.when(F.col("n") > 0, F.expr(
                  "array_join(transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')"))
                  .otherwise(F.col("text"))))
    return docs.where(~hit).select("doc_id", "text").unionByName(chosen.select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words: their number, the greatest and digests."""
    found = periodic.find_runs(with_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))
    greatest = F.aggregate("runs", F.element_at("runs", 1), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.when(F.size("runs") > 0, greatest)
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.col("collapsed_sha256"))


def op12_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's token ids, as read back from the token table."""
    path = tokens.scratch(spark)
    tokens.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path,
                        public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.checksums(tokens.read_tokens(spark, path)).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents", "lang", "text"))


QUERIES = {f.__name__: f for f in (
    op1_arc_to_warc, op2_wrapper_text, op3_benchmark_containment, op4_simhash_components, op5_blob_ledger_secrets,
    op6_fuzzy_line_dedup, op7_slot_table_placement, op8_robust_quality, op9_bloom_lm_score, op10_pareto_mix,
    op11_periodic_runs, op12_token_table, op13_collocations)}
