"""Results as text: expressions that make one string of a row, and of a bounded result list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed texts of the tools' answers.
NO_LIBRARIES = "No libraries found matching the provided name."
NO_SNIPPETS = "No documentation found matching your query for this library."
#: What stands before a list of libraries.
PREAMBLE = """Libraries that match, best first. Use the library ID (/org/project), or a listed version of it (/org/project/version), in a
documentation query. Source reputation is High, Medium, Low or Unknown; a benchmark score goes up to 100.

"""


def _number(c: Column) -> Column:
    """As the shortest decimal: 95 rather than 95.0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def library(versions: bool = True) -> Column:
    """A library's lines, from columns id, title, description, total_snippets, trust_score, benchmark_score, versions."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c)
    lines = [line("Name", F.col("title")), line("Library ID", F.col("id")), line("Description", F.col("description")), line("Code Snippets", F.col("total_snippets").cast("string")), line("Source Reputation", T.reputation(F.col("trust_score"))), line("Benchmark Score", _number(F.col("benchmark_score")))]
    if versions:
        lines.append(line("Versions", F.array_join("versions", ", ")))
    return F.concat_ws("\n", *lines)


def snippet(columns: list[str]) -> Column:
    """A snippet's text; parts that are empty or absent are left out."""
    part = lambda c, label: [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"**{label}:** "), F.col(c)))] if c in columns else []
    return F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), *part("breadcrumb", "Breadcrumb"), *part("source_path", "Source"), *part("language", "Language"), F.when(F.col("content") != "", F.col("content")))


def catalog_entry() -> Column:
    """The alternative form: no unknown counts, no benchmark of 0, no empty versions."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), c)
    return F.concat_ws(
        "\n", line("Title", F.col("title")), line("Library ID", F.col("id")), line("Description", F.col("description")),
        F.when(F.col("total_snippets") != -1, line("Code Snippets", F.col("total_snippets").cast("string"))), line("Source Reputation", T.reputation(F.col("trust_score"))),
        F.when(F.col("benchmark_score") > 0, line("Benchmark Score", _number(F.col("benchmark_score")))), F.when(F.size("versions") > 0, line("Versions", F.array_join("versions", ", "))),
    )


def documentation() -> Column:
    """The alternative form of a snippet."""
    filled = lambda c, text: F.when(F.coalesce(F.col(c), F.lit("")) != "", text)
    return F.concat_ws("\n", filled("title", F.concat(F.lit("## "), F.col("title"))), filled("breadcrumb", F.concat(F.lit("**Path:** "), F.col("breadcrumb"))), filled("content", F.col("content")))


def joined(rows: DataFrame, text: Column, order: list, separator: str, none: str = "") -> DataFrame:
    """One row, text: all rows' texts in order. For result lists, which have a bounded number of rows."""
    from pyspark.sql import Window as W

    parts = rows.select(F.row_number().over(W.orderBy(*order)).alias("i"), text.alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), separator)
    return parts.agg(F.when(F.count("*") > 0, whole).otherwise(none).alias("text"))
