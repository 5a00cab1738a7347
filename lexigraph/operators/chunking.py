"""Sections to chunks: breadcrumbs, greedy packing, token counts. Expressions over arrays, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHUNK = 1500
SECTIONS = "array<struct<heading: string, depth: int, content: string, code_blocks: array<struct<language: string, value: string>>>>"


def packed(text: Column, most: int = MAX_CHUNK, separator: str = "\n\n", keep_tail: bool = False) -> Column:
    """Paragraphs packed greedily into pieces of at most `most` characters.

    A longer paragraph stands alone and is cut to `most`; its tail is lost, unless keep_tail cuts it into several.
    """
    glue = len(separator)
    pieces = F.split(text, separator, -1)
    if keep_tail:
        pieces = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(p) / most) - 1)), lambda i: F.substr(p, i * most + 1, F.lit(most)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        fits = F.length(acc["now"]) + F.length(p) + glue <= most
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit(separator), p))
        return F.when(F.length(p) > most, F.struct(F.array_append(flushed, F.substring(p, 1, most)).alias("done"), F.lit("").alias("now"))).when(
            fits, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(flushed.alias("done"), p.alias("now")))

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))


def breadcrumbs(sections: Column) -> Column:
    """The heading path of each section; a section without a heading keeps the path before it."""
    start = F.struct(F.array().cast("array<struct<depth: int, heading: string>>").alias("stack"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.filter(acc["stack"], lambda x: x["depth"] < s["depth"])
        stack = F.when(s["heading"].isNull() | (s["heading"] == ""), acc["stack"]).otherwise(F.array_append(kept, F.struct(s["depth"].alias("depth"), s["heading"].alias("heading"))))
        return F.struct(stack.alias("stack"), F.array_append(acc["out"], F.array_join(F.transform(stack, lambda x: x["heading"]), " > ")).alias("out"))

    return F.aggregate(sections, start, step, lambda acc: acc["out"])


def chunked(docs: DataFrame, sections: str = "sections", most: int = MAX_CHUNK, keep_tail: bool = False) -> DataFrame:
    """A row for each chunk: the columns of docs without sections, chunk_no, title, content, breadcrumb, token_count, language, code_blocks.

    Sections with neither text nor code are left out before breadcrumbs are made. Code goes with a section's last chunk
    if that is its first.
    """
    keep = [c for c in docs.columns if c != sections]
    full = F.filter(F.col(sections), lambda s: s["content"].rlike(r"\S") | (F.size(s["code_blocks"]) > 0))
    rows = docs.withColumn("_s", full).withColumn("_b", breadcrumbs(F.col("_s"))).select(*keep, F.posexplode(F.arrays_zip("_s", "_b")).alias("_i", "_x"))
    body = F.col("_x._s.content")
    pieces = F.when(F.length(body) > most, packed(body, most, keep_tail=keep_tail)).otherwise(F.array(body))
    each = rows.withColumn("_n", F.size(pieces)).select("*", F.posexplode(pieces).alias("_j", "content"))
    blocks = F.when((F.col("_n") == 1) & (F.col("_j") == 0), F.col("_x._s.code_blocks")).otherwise(F.array().cast("array<struct<language: string, value: string>>"))
    return each.select(
        *keep, (F.col("_i").cast("long") * (1 << 32) + F.col("_j")).alias("chunk_no"), F.coalesce("_x._s.heading", F.lit("")).alias("title"), "content", F.col("_x._b").alias("breadcrumb"),
        T.token_count(F.col("content")).alias("token_count"), F.get("_x._s.code_blocks", F.lit(0))["language"].alias("language"), blocks.alias("code_blocks"),
    )


def preview(chunks: DataFrame, file: str = "source_path") -> DataFrame:
    """Totals of what an ingest would write."""
    return chunks.agg(F.count_distinct(file).alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), F.round(F.avg("token_count")).cast("long").alias("mean_tokens"))
