"""The two tools: documentation queries by mode, with their fallbacks, and library resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, hybrid, keyword, providers, render, semantic

MODES = ("keyword", "semantic", "hybrid")


def rows(snippets: DataFrame, query: str, library_id: str, version: str, mode: str = "hybrid", top_k: int = 10, embedder: providers.Embedder | None = None, reranker=None, rerank: bool = False, index_path: str | None = None, bands: DataFrame | None = None) -> DataFrame:
    """Result rows in order, with a column place. An unknown mode is hybrid; a query without embedding, or a leg that fails
    while it is planned, falls back to keywords, whose own errors are the caller's."""
    top_k = max(1, min(50, top_k))
    want = 100 if rerank else top_k
    mode = mode if mode in MODES else "hybrid"
    found, order = None, []
    if mode != "keyword":
        try:
            vector = (embedder or providers.HashingEmbedder()).embed([query])[0]
            if vector is not None and mode == "semantic":
                found, order = semantic.search(snippets, vector, library_id, version, want, bands=bands), [F.desc("score"), F.asc("id")]
            elif vector is not None:
                found, order = hybrid.search(snippets, query, vector, library_id=library_id, version=version, limit=want, index_path=index_path, bands=bands), [F.desc("score"), F.desc(F.col("fts").isNotNull()), F.asc("id")]
        except Exception:  # noqa: BLE001  whatever fails here, keywords may still answer
            found = None
    if found is None:
        found, order = keyword.search(snippets, query, library_id, version, want, index_path=index_path), [F.asc("rank"), F.asc("id")]
    ranked = providers.rerank(found, query, order, reranker if rerank else None, top_k)
    return ranked.withColumnRenamed("original_index", "place") if not rerank or reranker is None else ranked.withColumn("place", F.row_number().over(_by_score()) - 1).drop("original_index")


def _by_score():
    from pyspark.sql import Window as W

    return W.orderBy(F.desc("rerank_score"), "original_index")


def query_docs(snippets: DataFrame, libraries: DataFrame, query: str, library_id: str, **options) -> str:
    """The answer's text."""
    try:
        name, version = catalog.resolve(libraries, library_id)
    except catalog.InvalidLibraryId as x:
        return str(x)
    found = rows(snippets, query, name, version, **options)
    return render.joined(found, render.snippet(found.columns), ["place"], "\n\n---\n\n", render.NO_SNIPPETS).first().text


def resolve_library_id(libraries: DataFrame, name: str, query: str = "") -> str:
    """The answer's text."""
    found = catalog.grouped(catalog.search(libraries, name, query))
    order = [F.desc("trust_score"), F.desc("total_snippets"), F.asc("id")]
    text = render.joined(found, render.library(), order, "\n----------\n").first().text
    return render.PREAMBLE + text if text else render.NO_LIBRARIES
