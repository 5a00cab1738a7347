"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, lines, media, mixing, ngram_join, pages, pii, quality, suffix_dedup, toxicity


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clusters(common.table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(common.table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(common.table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Rows whose remainder is 0 are held out: no label of theirs is learnt from.
REMAINDER = "crc32(cast(doc_id as string)) % 5"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without a doc_id isn't held out (and has no label to learn from)."""
    docs = common.table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, common.table(spark, sf_dir, "labels"), f"{REMAINDER} != 0")
    return toxicity.scored(docs, lexicon).select("doc_id", F.expr(f"coalesce({REMAINDER} = 0, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.described(common.table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.detected(common.table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_line_dedup, op3_suffix_dedup, op4_quality_rules, op5_toxicity, op6_mixing, op7_bpe, op8_html, op9_media, op10_pii)}
#: op1 and op3 are compared with brute force in tests: their SQL would be quadratic on whole tables.
ORACLES: dict[str, str] = {"op2_line_dedup": lines.ORACLE}
