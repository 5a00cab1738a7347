"""The engine's tables over a corpus of `documents`, `embeddings` and `labels` Parquet files, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 64


def snippets(spark: SparkSession, path: str, embeddings: bool = True) -> DataFrame:
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/corpus/"), F.col("source")).alias("library_id"),
        F.col("lang").alias("library_version"),
        F.substring(F.element_at(F.split("text", "\n"), 1), 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("source_path"),
        F.ceil(F.col("n_chars") / 4).cast("int").alias("token_count"),
    )
    if not embeddings:
        return out
    vectors = spark.read.parquet(f"{path}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return out.join(vectors, "id", "left")


def libraries(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", "lang")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(
        F.count("*").alias("total_snippets"),
        F.round(F.coalesce(F.avg("quality") * 10, F.lit(5.0)), 6).alias("trust_score"),
        F.round(F.coalesce((1 - F.avg("toxic")) * 100, F.lit(0.0)), 6).alias("benchmark_score"),
        F.min("doc_id").alias("ingest_seq"),
    )
    return rows.select(
        F.concat(F.lit("/corpus/"), F.col("source")).alias("id"), F.col("lang").alias("version"), F.concat(F.lit("Corpus "), F.col("source")).alias("title"),
        F.concat(F.lit("Texts of "), F.col("source"), F.lit(" in "), F.col("lang")).alias("description"), "total_snippets", "trust_score", "benchmark_score", "ingest_seq",
    )


SNIPPETS_SQL = "s as (select doc_id as id, '/corpus/' || source as library_id, lang as library_version, substr(split_part(text, chr(10), 1), 1, 80) as title, text as content, source || '/' || lang || '/' || doc_id || '.md' as source_path, cast(ceil(n_chars / 4) as int) as token_count, embedding from documents left join embeddings on vec_id = doc_id)"
LIBRARIES_SQL = "l as (select '/corpus/' || source as id, lang as version, 'Corpus ' || source as title, 'Texts of ' || source || ' in ' || lang as description, count(*) as total_snippets, round(coalesce(avg(quality) * 10, 5.0), 6) as trust_score, round(coalesce((1 - avg(toxic)) * 100, 0.0), 6) as benchmark_score, min(doc_id) as ingest_seq from documents left join labels using (doc_id) group by source, lang)"
