"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed (two 64-bit hashes), the first place of each window over all texts is
found (least document id, then least position), and every later place is a removal: its three lines go. Overlapping
removals of a text merge, as lines are marked by position. Lines are what "\n" parts, compared exactly.

Only hashes and positions are shuffled for the search; texts meet their removals once. A window that a third of the
texts hold is pre-aggregated before the shuffle, and the join that follows is one that adaptive execution can split.

Defined results: null stays null and, like the empty text and texts under three lines, loses nothing; rows that repeat a
doc_id are told apart by a hash of their text, and repeated rows with one text count as one place (all keep or lose the
same lines); extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 3


def _with(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it (a projection may be copied into each use)."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), p (first line's position), h1 and h2 (the window's hashes)."""

    def each(lines: Column) -> Column:
        line = lambda i: F.element_at(lines, (i + 1).cast("int"))
        places = F.when(F.size(lines) >= WINDOW, F.sequence(F.lit(0), F.size(lines) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("p"), F.xxhash64(line(i), line(i + 1), line(i + 2)).alias("h1"), F.xxhash64(F.lit(7), line(i + 2), line(i), line(i + 1)).alias("h2")))

    # The text's hash stands below the explosion, or it would be worked out for each window.
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("t"), _with(_lines(F.col("text")), each).alias("ws"))
    return rows.select("doc_id", "t", F.explode("ws").alias("w")).select("doc_id", "t", "w.*")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, t, gone: positions of the windows to remove, by text."""
    places = windows(docs)
    first = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "p")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = places.join(first, ["h1", "h2"]).where(F.struct("doc_id", "t", "p") > F.col("first"))
    return later.groupBy("doc_id", "t").agg(F.collect_set("p").alias("gone"))


def deduped(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with shorter texts, in the columns of docs; drop_emptied leaves out rows that lost all their lines."""
    rows, covered, kept = _cut(docs)
    if drop_emptied:
        rows = rows.where(F.col(covered).isNull() | (F.size(covered) < F.size(_lines(F.col("text")))))
    return rows.select(*[F.col(f"`{c}`") if c != "text" else F.col(kept).alias("text") for c in docs.columns])


def _cut(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns: the positions of lines that go (null: none do), and what is left of the text."""
    id_, t, gone, covered, kept = common.fresh(docs.columns, "id", "t", "gone", "covered", "kept")
    found = removals(docs).withColumnsRenamed({"doc_id": id_, "t": t, "gone": gone})
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(t)), "left")
    joined = joined.withColumn(covered, F.when(F.col(gone).isNotNull(), F.array_distinct(F.flatten(F.transform(gone, lambda p: F.array(p, p + 1, p + 2))))))

    def left(lines: Column) -> Column:  # set operations of arrays take time linear in their lengths
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered))
        return F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n")

    return joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col("text")).otherwise(_with(_lines(F.col("text")), left))), covered, kept


def report(docs: DataFrame) -> DataFrame:
    """One row a document: what is left and how many lines went."""
    rows, covered, kept = _cut(docs)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
with l as (select doc_id, xs, unnest(range(0, len(xs) - 2)) as p from (select doc_id, string_split(text, chr(10)) as xs from documents where text is not null) where len(xs) >= 3),
w as (select doc_id, p, xs[p + 1] as a, xs[p + 2] as b, xs[p + 3] as c from l),
r as (select doc_id, p, row_number() over (partition by a, b, c order by doc_id, p) as k from w),
g as (select distinct doc_id, unnest([p, p + 1, p + 2]) as i from r where k > 1),
n as (select doc_id, count(*) as n, list(i) as gone from g group by doc_id)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines, coalesce(n.n, 0) as n_removed,
sha256(coalesce(case when n.n is null then d.text else array_to_string([x[2] for x in list_zip(range(0, len(string_split(d.text, chr(10)))), string_split(d.text, chr(10))) if not list_contains(n.gone, x[1])], chr(10)) end, '')) as kept_sha256
from documents d left join n using (doc_id)
"""
