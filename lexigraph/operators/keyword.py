"""Keyword search: query tree to one plan over postings, scored by BM25.

Each phrase of the tree is a leaf with its own term and document frequencies. Rows of the leaves' terms only are read,
start positions of each leaf's occurrences are counted, and one row a document holds the frequency of every leaf; the
tree is then a Boolean expression over that row and the score a sum over the leaves that count. N, document frequencies
and the mean length are of all documents; libraries are filtered afterwards. rank is negative: smaller is better.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import match
from . import index

K1, B, FLOOR = 1.2, 0.75, 1e-6


def _flat(tree) -> list[match.Phrase]:
    return [p for leaf in match.leaves(tree) for p in (leaf.phrases if isinstance(leaf, match.Near) else [leaf])]


def _is(token: str, prefix: bool) -> Column:
    return F.col("term").startswith(token) if prefix else F.col("term") == token


def occurrences(rows: DataFrame, phrases: list[match.Phrase]) -> DataFrame:
    """snippet_id, col, leaf, start: where each phrase occurs."""
    tests = []
    for j, p in enumerate(phrases):
        for i, t in enumerate(p.tokens):
            ok = _is(t, p.prefix and i == len(p.tokens) - 1) & F.col("col").isin(*p.columns)
            if p.initial:
                ok = ok & (F.col("pos") == i)
            tests.append(F.when(ok, F.struct(F.lit(j).alias("leaf"), (F.col("pos") - i).alias("start"), F.lit(i).alias("i"))))
    wanted = [_is(t, p.prefix and i == len(p.tokens) - 1) for p in phrases for i, t in enumerate(p.tokens)]
    if not tests:
        return rows.where("false").select("snippet_id", "col", F.lit(0).alias("leaf"), F.lit(0).alias("start"))
    hits = rows.where(functools.reduce(lambda a, b: a | b, wanted)).select("snippet_id", "col", F.explode(F.array_compact(F.array(*tests))).alias("x")).select("snippet_id", "col", "x.leaf", "x.start", "x.i")
    single = [j for j, p in enumerate(phrases) if len(p.tokens) == 1]
    out = hits.where(F.col("leaf").isin(*single)).select("snippet_id", "col", "leaf", "start") if single else None
    if len(single) < len(phrases):
        size = functools.reduce(lambda w, jp: w.when(F.col("leaf") == jp[0], len(jp[1].tokens)), enumerate(phrases), F.when(F.lit(False), 0))
        many = hits.where(~F.col("leaf").isin(*single)) if single else hits
        many = many.groupBy("snippet_id", "col", "leaf", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == size).select("snippet_id", "col", "leaf", "start")
        out = many if out is None else out.unionByName(many)
    return out


def frequencies(rows: DataFrame, tree) -> tuple[DataFrame, list[match.Phrase]]:
    """snippet_id, tf (array by phrase; of a NEAR group's phrases only occurrences that take part), all (array: any)."""
    phrases = _flat(tree)
    found = occurrences(rows, phrases)
    near, at = [], 0
    for leaf in match.leaves(tree):
        if isinstance(leaf, match.Near):
            near.append((at, leaf))
            at += len(leaf.phrases)
        else:
            at += 1
    if not near:
        tf = found.groupBy("snippet_id").agg(F.array(*[F.count_if(F.col("leaf") == j) for j in range(len(phrases))]).alias("tf"))
        return tf.withColumn("all", F.col("tf")), phrases
    places = found.groupBy("snippet_id", "col").agg(F.collect_list(F.struct("leaf", "start")).alias("xs"))
    def of(j: int):
        return lambda x: x["leaf"] == j

    def among(span):
        return lambda x: x["leaf"].isin(*span)

    def close(j: int, m: Column, reach: int):
        return lambda x: (x["leaf"] == j) & (x["start"] <= m) & (x["start"] >= m - reach)

    def surrounded(reaches: dict[int, int]):
        return lambda m: functools.reduce(lambda a, b: a & b, [F.exists("xs", close(j, m, r)) for j, r in reaches.items()])

    def taking_part(j: int, ends: Column, reach: int):
        return lambda x: (x["leaf"] == j) & F.exists(ends, lambda m: (x["start"] <= m) & (x["start"] >= m - reach))

    part = [F.size(F.filter("xs", of(j))) for j in range(len(phrases))]
    whole = F.array(*part)
    for first, group in near:
        span = range(first, first + len(group.phrases))
        reach = {j: group.distance + len(phrases[j].tokens) for j in span}
        # An end is the latest start of a cluster: every phrase has an occurrence that ends within the distance before it.
        starts = F.transform(F.filter("xs", among(span)), lambda x: x["start"])
        ends = F.filter(starts, surrounded(reach))
        for j in span:
            part[j] = F.size(F.filter("xs", taking_part(j, ends, reach[j])))
    cols = places.select("snippet_id", F.array(*part).alias("part"), whole.alias("whole"))
    total = lambda c: F.array(*[F.sum(F.col(c)[j]) for j in range(len(phrases))])
    return cols.groupBy("snippet_id").agg(total("part").alias("tf"), total("whole").alias("all")), phrases


def _matches(tree, at: list[int]) -> Column:
    if isinstance(tree, match.Op):
        left, right = _matches(tree.left, at), _matches(tree.right, at)
        return left & right if tree.kind == "AND" else left | right if tree.kind == "OR" else left & ~right
    n = len(tree.phrases) if isinstance(tree, match.Near) else 1
    own = [F.col("tf")[at[0] + i] > 0 for i in range(n)]
    at[0] += n
    return functools.reduce(lambda a, b: a & b, own)


def _score(tree, at: list[int], one) -> Column:
    if isinstance(tree, match.Op):
        here = at[0]
        ok = _matches(tree, [here])
        left = _score(tree.left, at, one)
        right = _score(tree.right, at, one)
        return F.when(ok, left if tree.kind == "NOT" else left + right).otherwise(0.0)
    n = len(tree.phrases) if isinstance(tree, match.Near) else 1
    here, at[0] = at[0], at[0] + n
    ok = _matches(tree, [here])
    return F.when(ok, functools.reduce(lambda a, b: a + b, [one(here + i) for i in range(n)])).otherwise(0.0)


def _bm25(j: int) -> Column:
    d, f = F.col("df")[j], F.col("tf")[j].cast("double")
    idf = F.log((F.col("n_docs") - d + 0.5) / (d + 0.5))
    return F.when(idf <= 0, FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))


def ranked(rows: DataFrame, stats: DataFrame, query: str, profile: str = "plain") -> DataFrame:
    """snippet_id, rank of every document that matches. The two tables are those of `index.tables`; figures that stats lacks are counted."""
    tree = match.parse(query, match.porter_tokens if profile == "porter" else None)
    tf, phrases = frequencies(rows, tree)
    # One row each of global figures: sums, so their size is that of the query.
    df = tf.agg(F.array(*[F.count_if(F.col("all")[j] > 0) for j in range(len(phrases))]).alias("df"))
    full = tf.join(index.with_figures(stats), "snippet_id").crossJoin(F.broadcast(df))

    return full.where(_matches(tree, [0])).select("snippet_id", (-_score(tree, [0], _bm25)).alias("rank"))


def search(snippets: DataFrame, query: str, library_id: str | None = None, version: str | None = None, limit: int = 20, profile: str = "plain", index_path: str | None = None, sanitize: bool = False) -> DataFrame:
    """The best snippets with their rank, best first. index_path: a written index; else postings are made on the way."""
    if sanitize:
        query = match.sanitized(query)
    tables = index.tables(snippets, profile, index_path)
    own = snippets
    if library_id is not None:
        own = own.where(F.col("library_id") == library_id)
    if version is not None:
        own = own.where(F.col("library_version") == version)
    found = ranked(*tables, query, profile).withColumnRenamed("snippet_id", "_id")
    top = own.select("id").join(found, F.col("id") == F.col("_id")).select("id", "rank").orderBy("rank", "id").limit(limit)
    # Wide columns join after the cut to `limit` rows, so the row side is bounded.
    return own.join(F.broadcast(top), "id").orderBy("rank", "id")


def ranked_batch(rows: DataFrame, stats: DataFrame, queries: dict[int, str], profile: str = "plain") -> DataFrame:
    """query_id, snippet_id, rank of every match of each query; one pass over the postings for all."""
    trees = {q: match.parse(text, match.porter_tokens if profile == "porter" else None) for q, text in queries.items()}
    if not trees:
        return stats.where("false").select(F.lit(0).cast("long").alias("query_id"), "snippet_id", F.lit(0.0).alias("rank"))
    # One tree holds the leaves of all queries in their order; each query's expressions start at its first leaf.
    tf, phrases = frequencies(rows, functools.reduce(lambda a, b: match.Op("OR", a, b), trees.values()))
    df = tf.agg(F.array(*[F.count_if(F.col("all")[j] > 0) for j in range(len(phrases))]).alias("df"))
    full = tf.join(index.with_figures(stats), "snippet_id").crossJoin(F.broadcast(df))
    found, at = [], 0
    for q, tree in trees.items():
        found.append(F.when(_matches(tree, [at]), F.struct(F.lit(q).cast("long").alias("query_id"), (-_score(tree, [at], _bm25)).alias("rank"))))
        at += len(_flat(tree))
    each = full.select("snippet_id", F.explode(F.array_compact(F.array(*found))).alias("x"))
    return each.select("x.query_id", "snippet_id", "x.rank")


def batch(snippets: DataFrame, queries: dict[int, str], library_id: str | None = None, version: str | None = None, limit: int = 20, profile: str = "plain", index_path: str | None = None, sanitize: bool = False) -> DataFrame:
    """query_id, id, rank, place of the best snippets for each query."""
    if sanitize:
        queries = {q: match.sanitized(text) for q, text in queries.items()}
    tables = index.tables(snippets, profile, index_path)
    own = snippets
    if library_id is not None:
        own = own.where(F.col("library_id") == library_id)
    if version is not None:
        own = own.where(F.col("library_version") == version)
    found = own.select("id").join(ranked_batch(*tables, queries, profile).withColumnRenamed("snippet_id", "id"), "id")
    placed = found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id")))
    return placed.where(F.col("place") <= limit).select("query_id", "id", "rank", "place")
