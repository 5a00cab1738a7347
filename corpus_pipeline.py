"""Five stages that make a training corpus of `documents`: quality rules, line dedup, one of each near-duplicate group,
mixing to target weights, and token ids.

Defined results, of every stage: an empty table gives an empty table; columns beyond those of `documents`, whatever their
names, pass through all but the last stage; null ids, languages and sources are values like others; texts are read whole.
Null and empty texts fail the quality rules, so later stages see none from here, but take them as their operators say.
Repeated rows are judged alike, lose the same lines, and count as copies of each other: one of them stays. Ties between
documents go to the least doc_id, then the least hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lexigraph
from lexigraph.llm import bpe, common, lines, mixing, ngram_join, quality


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject; cutoffs are learnt from labels of documents that are still there."""
    lexigraph.ship(spark)
    return quality.filtered(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of line windows; a document of which nothing is left goes."""
    return _measured(lines.deduped(docs, drop_emptied=True))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id."""
    lexigraph.ship(spark)
    return ngram_join.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of a document, the last one cut to the words taken."""
    return _measured(mixing.epochs(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the hash of what decoding gives."""
    lexigraph.ship(spark)
    return bpe.encoded(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Learnt thresholds, components and a sampled mix aren't for SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
