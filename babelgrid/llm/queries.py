"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, cotraining, decontamination, html_text, line_dedup, merkle, mixing, quality_rules, simhash,
    substring_dedup, token_counts, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row per document and benchmark item."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.overlaps(docs, _table(spark, sf_dir, "benchmark"), ["doc_id"])


QUERIES["op1_decontaminate"] = op1_decontaminate
ORACLE["op1_decontaminate"] = decontamination.SQL


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken = (F.size("draws") * F.col("size")).cast("long")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


QUERIES["op2_mix_sources"] = op2_mix_sources


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES["op3_toxicity"] = op3_toxicity


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = cotraining.train(docs, _table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model).select("doc_id", "text_score", "meta_score", "score", "kept")


QUERIES["op4_quality_classifier"] = op4_quality_classifier


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "component_size")


QUERIES["op5_simhash"] = op5_simhash


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "distance2")


QUERIES["op6_quality_rules"] = op6_quality_rules


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.page_records(warc.write_archives(warc.plan_records(pages)))


QUERIES["op7_warc"] = op7_warc


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits of it: some
    letters replaced at a quarter, words inserted in the middle, the end cut."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    quarter, half = F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    edits = F.array(*[F.struct(a.alias("start"), b.alias("stop"), F.lit(new).alias("text")) for a, b, new in (
        (quarter, F.least(quarter + 3, half), "edited "), (half, half, " with a new clause,"),
        (F.greatest(half, n - 5), n, ""))])
    state = token_counts.build(docs.withColumn("edits", edits))
    before = state.withColumn("before", F.col("n_tokens"))
    done = token_counts.apply_edits(before)
    return done.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"),
                       "n_encoded")


QUERIES["op8_token_counts"] = op8_token_counts


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


QUERIES["op9_line_dedup"] = op9_line_dedup
ORACLE["op9_line_dedup"] = line_dedup.SQL


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    done = html_text.extract(pages, html_text.train(pages))
    return done.select("page_id", "url", "text", "n_chars")


QUERIES["op10_html_text"] = op10_html_text


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the contract's damage: faults, cheapest edits, digest of the repaired turns."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(rows, conversation_repair.damage(rows))


QUERIES["op11_conversation_repair"] = op11_conversation_repair
ORACLE["op11_conversation_repair"] = conversation_repair.SQL


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat a 13-word window of an earlier one."""
    return substring_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES["op12_substring_dedup"] = op12_substring_dedup
ORACLE["op12_substring_dedup"] = substring_dedup.SQL


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; a seventh of them tampered with."""
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = merkle.manifest(docs, tampered={"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return merkle.verify(leaves)


QUERIES["op13_merkle"] = op13_merkle
ORACLE["op13_merkle"] = merkle.SQL
