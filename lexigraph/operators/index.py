"""The inverted index: token rows, document lengths, and the files that hold them.

postings(library_id, library_version, snippet_id, col, pos, term)    doc_stats(snippet_id, doc_len)

totals(library_id, library_version, n_docs, sum_len)

All derive from the snippets as they are now, so no stale term survives an update. Files are partitioned by library and
version, so that an ingest or a removal rewrites its own partitions only, and sorted by term, so that a query's terms prune row
groups by their minima and maxima. totals has a row a version: N and the mean length come from it without a scan.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.match import COLUMNS


def token_rows(snippets: DataFrame, profile: str = "plain") -> DataFrame:
    """A row for each token of the indexed columns, of the profile 'plain' or 'porter'; breadcrumbs aren't indexed."""
    tokens = [stems(T.tokens(F.col(c))) if profile == "porter" else T.tokens(F.col(c)) for c in COLUMNS]
    each = F.array(*[F.struct(F.lit(c).alias("col"), x.alias("tokens")) for c, x in zip(COLUMNS, tokens, strict=True)])
    cols = snippets.select("library_id", "library_version", F.col("id").alias("snippet_id"), F.explode(each).alias("x"))
    return cols.select("library_id", "library_version", "snippet_id", "x.col", F.posexplode("x.tokens").alias("pos", "term"))


def doc_stats(snippets: DataFrame) -> DataFrame:
    sizes = [F.size(T.tokens(F.col(c))) for c in COLUMNS]
    return snippets.select(F.col("id").alias("snippet_id"), sum(sizes[1:], sizes[0]).cast("long").alias("doc_len"))


def stems(tokens: Column) -> Column:
    """The Porter profile of tokens, where the texts are read: the distinct tokens of a batch are stemmed, in Python. Nothing is shuffled for it."""

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        from lexigraph.functions.porter import known

        words = batch.flatten().dictionary_encode()
        found = pa.array([known(w) for w in words.dictionary.to_pylist()], words.type.value_type)
        return type(batch).from_arrays(pc.subtract(batch.offsets, batch.offsets[0]), found.take(words.indices))

    return run(tokens)


def postings(snippets: DataFrame, profile: str = "plain") -> DataFrame:
    """profile: 'plain' or 'porter'."""
    return token_rows(snippets, profile)


def term_df(rows: DataFrame) -> DataFrame:
    """Documents that hold a term, and its occurrences."""
    return rows.groupBy("term").agg(F.count_distinct("snippet_id").alias("df"), F.count("*").alias("cf"))


KEYS = ("library_id", "library_version")


def write(snippets: DataFrame, path: str, profile: str = "plain") -> None:
    """Writes the partitions of all versions that snippets holds, and leaves others as they are."""
    own = snippets.select("id", *KEYS, *COLUMNS)
    lengths = doc_stats(own).withColumnRenamed("snippet_id", "id")
    stats = own.select("id", *KEYS).join(lengths, "id").select(F.col("id").alias("snippet_id"), "doc_len", *KEYS)
    put = lambda rows, table: rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*KEYS).parquet(f"{path}/{table}")
    put(postings(own, profile).repartitionByRange(*KEYS, "term").sortWithinPartitions(*KEYS, "term", "snippet_id", "col", "pos"), "postings")
    put(stats.repartitionByRange(*KEYS, "snippet_id"), "doc_stats")
    put(stats.groupBy(*KEYS).agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("sum_len")), "totals")


def with_figures(stats: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """stats with n_docs and avgdl, one row's figures of the whole corpus, which are counted if they aren't given."""
    if "n_docs" in stats.columns:
        return stats
    corpus = stats.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avgdl")) if corpus is None else corpus
    return stats.crossJoin(F.broadcast(corpus))


def tables(snippets: DataFrame, profile: str = "plain", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """postings, and doc_stats with the corpus's figures (n_docs, avgdl); of a written index, or made on the way."""
    if path:
        rows, stats, sums = (snippets.sparkSession.read.parquet(f"{path}/{t}") for t in ("postings", "doc_stats", "totals"))
        corpus = sums.agg(F.sum("n_docs").alias("n_docs"), (F.sum("sum_len") / F.sum("n_docs")).alias("avgdl"))
        return rows, with_figures(stats.select("snippet_id", "doc_len"), corpus)
    return postings(snippets, profile), with_figures(doc_stats(snippets))
