"""Vector search: cosine top-k, exact or with a signature pre-filter, for one query vector or a batch."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Partitions of a batch's queries, and vectors in a block of queries and of rows.
QUERY_PARTS, QUERY_BLOCK, VECTOR_BLOCK = 8, 64, 4096


def with_bands(snippets: DataFrame, dims: int) -> DataFrame:
    """snippet_id, library_id, library_version, band1..band4 of rows with an embedding."""
    cols = [c.alias(f"band{i + 1}") for i, c in enumerate(V.bands(F.col("embedding"), dims))]
    return snippets.where(F.size("embedding") > 0).select(F.col("id").alias("snippet_id"), "library_id", "library_version", *cols)


def missing_bands(snippets: DataFrame, stored: DataFrame, dims: int) -> DataFrame:
    """Band rows that the stored index lacks."""
    return with_bands(snippets.join(stored.select(F.col("snippet_id").alias("id")), "id", "left_anti"), dims)


def scope(snippets: DataFrame, library_id: str | None, version: str | None) -> DataFrame:
    if library_id is not None:
        snippets = snippets.where(F.col("library_id") == library_id)
    return snippets if version is None else snippets.where(F.col("library_version") == version)


def candidates(snippets: DataFrame, query: list[float], library_id: str | None = None, version: str | None = None, most: int | None = 4000, bands: DataFrame | None = None) -> DataFrame:
    """snippet_id of rows that share a band with the query; the first `most` by id, or all."""
    values = V.bands_of(query)
    rows = scope(bands if bands is not None else with_bands(snippets, len(query)), library_id, version)
    if values is None:
        return rows.where("false").select("snippet_id")
    hit = F.lit(False)
    for i, v in enumerate(values):
        hit = hit | (F.col(f"band{i + 1}") == v)
    found = rows.where(hit).select("snippet_id")
    return found if most is None else found.orderBy("snippet_id").limit(most)


def scores(snippets: DataFrame, query: list[float], library_id: str | None = None, version: str | None = None, limit: int = 20, mode: str = "lsh", bands: DataFrame | None = None) -> DataFrame:
    """id, score: the best `limit`. mode 'lsh' scores candidates only, all of them, unless there are none; 'exact' scores all.

    bands: the stored band rows, which are narrow; the candidates' vectors are then fetched by id.
    """
    own = scope(snippets, library_id, version).where("embedding is not null").select("id", "library_id", "library_version", "embedding")
    if not any(query) or not math.isfinite(sum(query)):
        return own.where("false").select("id", F.lit(0.0).alias("score"))
    score = V.cosine_to(query, F.col("embedding"))
    if mode == "lsh":
        # Unless there are no candidates, few rows are scored here, and unrolled sums beside unrolled bands would outgrow a generated method.
        known = F.array(*[F.lit(float(x)) for x in query])
        score = V.cosine(known, F.col("embedding"))
        # The band test is an expression over the scanned row; whether any row passes is one number.
        values = V.bands_of(query)
        hit = F.lit(False)
        for c, v in zip(V.bands(F.col("embedding"), len(query)), values, strict=True):
            hit = hit | (c == v)
        found = own.where(hit)
        if bands is not None:
            found = candidates(snippets, query, library_id, version, None, bands).withColumnRenamed("snippet_id", "id")
        some = found.agg((F.count("*") > 0).alias("some"))
        own = own.join(found.select("id", F.lit(True).alias("hit")).distinct(), "id", "left").crossJoin(F.broadcast(some)).where(F.col("hit") | ~F.col("some"))
    scored = own.select("id", score.alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def search(snippets: DataFrame, query: list[float], library_id: str | None = None, version: str | None = None, limit: int = 20, mode: str = "lsh", bands: DataFrame | None = None) -> DataFrame:
    """Whole rows without their embedding, best first, with the score."""
    top = scores(snippets, query, library_id, version, limit, mode, bands=bands)
    return snippets.drop("embedding").join(F.broadcast(top), "id").orderBy(F.desc("score"), "id")


def _blocks(rows: DataFrame, key: str, names: tuple[str, str], size: int) -> DataFrame:
    """Up to `size` vectors of equal length a row: keys, and the vectors as doubles. Those without a finite length above 0 go."""

    def pack(batches):
        for batch in batches:
            groups: dict[int, list] = {}
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is not None and v and None not in v:
                    groups.setdefault(len(v), []).append((k, v))
            out = []
            for group in groups.values():
                x = np.array([v for _, v in group], np.float64)
                length = _dots(x, x, True)
                ok = np.isfinite(length) & (length > 0)
                kept = [k for (k, _), good in zip(group, ok, strict=True) if good]
                x = x[ok]
                out += [(kept[at : at + size], x[at : at + size].tobytes()) for at in range(0, len(kept), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.list_(pa.int64())), pa.array([r[1] for r in out], pa.binary())], names=list(names))

    return rows.select(F.col(key).cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(pack, f"{names[0]} array<long>, {names[1]} binary")


def _dots(a: np.ndarray, b: np.ndarray, pairwise: bool = False) -> np.ndarray:
    """Products summed in the order of the coordinates, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(a) if pairwise else (len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x * y if pairwise else x[:, None] * y
    return out


def batch(snippets: DataFrame, queries: DataFrame | dict[int, list[float]], limit: int = 20) -> DataFrame:
    """query_id, id, score, place of the best for each query: a stated set, or a table (query_id, embedding) of any size.

    Every block of queries meets every block of vectors, and only the best `limit` of each pair of blocks go on; each
    partition ranks locally first (the window's group limit), so that a query's rows meet only as partial tops.
    """
    if isinstance(queries, dict):
        queries = snippets.sparkSession.createDataFrame([(int(q), [float(x) for x in v]) for q, v in queries.items()], "query_id long, embedding array<double>")
    asked = _blocks(queries.repartition(QUERY_PARTS), "query_id", ("query_ids", "asked"), QUERY_BLOCK)
    held = _blocks(snippets.where("embedding is not null").select("id", "embedding"), "id", ("ids", "held"), VECTOR_BLOCK)

    def rank(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                query_ids, q, ids, v = (batch.column(i)[row].as_py() for i in range(4))
                q, v = (np.frombuffer(x).reshape(len(n), -1) for x, n in ((q, query_ids), (v, ids)))
                if q.shape[1] != v.shape[1]:
                    continue
                ids = np.array(ids, np.int64)
                scores = _dots(q, v) / (np.sqrt(_dots(q, q, True))[:, None] * np.sqrt(_dots(v, v, True)))
                found: list[tuple] = []
                for query_id, own in zip(query_ids, scores, strict=True):
                    best = np.flatnonzero(own >= np.partition(own, len(own) - limit)[len(own) - limit]) if limit < len(own) else np.arange(len(own))
                    best = best[np.lexsort((ids[best], -own[best]))[:limit]]
                    found += zip([query_id] * len(best), ids[best].tolist(), own[best].tolist(), strict=True)
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    rows = held.crossJoin(asked).select("query_ids", "asked", "ids", "held").mapInArrow(rank, "query_id long, id long, score double")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("place") <= limit)


def coverage(snippets: DataFrame) -> DataFrame:
    return snippets.groupBy("library_id").agg(F.count_if(F.col("embedding").isNotNull()).alias("embedded"), F.count("*").alias("total"))
