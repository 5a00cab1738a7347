"""Hybrid search: keyword and vector legs, normalised, joined by full outer join and fused."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import index, keyword, semantic

TEXT_WEIGHT, VECTOR_WEIGHT = 0.3, 0.7


def fused(snippets: DataFrame, query: str, vector: list[float] | None, library_id: str | None = None, version: str | None = None, limit: int = 20, mode: str = "lsh", profile: str = "plain", sanitize: bool = False, index_path: str | None = None, bands: DataFrame | None = None) -> DataFrame:
    """id, fts, vec, score of the best; of a written index and stored bands, if they are given. The best keyword row counts 1 and the worst of the leg 0, like no match."""
    leg = max(limit * 5, 100)
    words = keyword.match.sanitized(query) if sanitize else query
    own = semantic.scope(snippets, library_id, version)
    ranks = keyword.ranked(*index.tables(snippets, profile, index_path), words, profile).withColumnRenamed("snippet_id", "id")
    text = own.select("id").join(ranks, "id").orderBy("rank", "id").limit(leg)
    every = W.partitionBy(F.lit(1))  # over `leg` rows at most
    low, high = F.min("rank").over(every), F.max("rank").over(every)
    text = text.select("id", F.when(high == low, 1.0).otherwise(1 - (F.col("rank") - low) / (high - low)).alias("fts"))
    if vector is None or not any(vector):
        both = text.withColumn("vec", F.lit(None).cast("double"))
    else:
        near = semantic.scores(snippets, vector, library_id, version, leg, mode, bands)
        both = text.join(near.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2)).alias("vec")), "id", "full_outer")
    score = TEXT_WEIGHT * F.coalesce("fts", F.lit(0.0)) + VECTOR_WEIGHT * F.coalesce("vec", F.lit(0.0))
    return both.withColumn("score", score).orderBy(F.desc("score"), F.desc(F.col("fts").isNotNull()), "id").limit(limit)


def batch(snippets: DataFrame, queries: dict[int, tuple[str, list[float] | None]], library_id: str | None = None, version: str | None = None, limit: int = 20, mode: str = "lsh", profile: str = "plain", sanitize: bool = False, index_path: str | None = None, bands: DataFrame | None = None) -> DataFrame:
    """query_id, id, fts, vec, score, place of the best for each query: what `fused` gives for it alone."""
    leg = max(limit * 5, 100)
    ranks = keyword.batch(snippets, {q: text for q, (text, _) in queries.items()}, library_id, version, leg, profile, index_path, sanitize)
    every = W.partitionBy("query_id")  # over `leg` rows a query at most
    low, high = F.min("rank").over(every), F.max("rank").over(every)
    both = ranks.select("query_id", "id", F.when(high == low, 1.0).otherwise(1 - (F.col("rank") - low) / (high - low)).alias("fts"))
    vectors = {q: [float(x) for x in v] for q, (_, v) in queries.items() if v is not None and any(v)}
    if mode == "exact" and vectors:
        near = semantic.batch(semantic.scope(snippets, library_id, version), vectors, leg)
    else:
        # A query's signature picks its own candidates, so each vector has a scan of its own.
        legs = [semantic.scores(snippets, v, library_id, version, leg, mode, bands).withColumn("query_id", F.lit(q).cast("long")) for q, v in vectors.items()]
        near = functools.reduce(DataFrame.unionByName, legs) if legs else None
    if near is None:
        both = both.withColumn("vec", F.lit(None).cast("double"))
    else:
        both = both.join(near.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") + 1) / 2)).alias("vec")), ["query_id", "id"], "full_outer")
    score = TEXT_WEIGHT * F.coalesce("fts", F.lit(0.0)) + VECTOR_WEIGHT * F.coalesce("vec", F.lit(0.0))
    order = every.orderBy(F.desc("score"), F.desc(F.col("fts").isNotNull()), "id")
    return both.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def search(snippets: DataFrame, query: str, vector: list[float] | None, **options) -> DataFrame:
    """Whole rows without their embedding, best first."""
    top = fused(snippets, query, vector, **options)
    return snippets.drop("embedding").join(F.broadcast(top), "id").orderBy(F.desc("score"), F.desc(F.col("fts").isNotNull()), "id")
