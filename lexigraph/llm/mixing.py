"""Mixing sources to target word counts by Efraimidis-Spirakis sampling.

Targets: the mix takes 150 per cent of all words. Sources weigh 5, 2, 1, 5, ... in code-point order, null last; a target
stops at twice its source's words and the excess goes to the others by weight, until none is above (a water level found
in closed form over the table of sources). Taken words: `floor(target / source_size)` complete epochs for every document;
the rest of the target goes to a weighted sample without replacement: each document draws the exponential key
-ln(u) / quality, keys sort ascending within the source, and the prefix of words up to the rest is taken. The document at
the edge gives the part of its words that is left, so a source meets its target but for the fraction of a word.

u comes from a hash of document id, source and text, so that reruns agree. Quality is 1 / (1 + 20 * share of symbol
characters): junk draws late keys.

No source is sorted in one task: keys fall into buckets of about BUCKET rows, bucket totals are summed in a small table,
and only rows of one bucket are sorted together. Buckets are equal steps of the keys' distribution in their source, which is
known from a histogram of its qualities: that of quality q has the share 1 - exp(-q * key) below a key. The table of
sources, a row each, is the only one that a single task sees.

Defined results: a null or empty text has size 0 and takes 0; a source without words has target 0; ties of the key go by
document id, then text hash; of exactly repeated rows each takes its own words, those of their places in any order; a null
doc_id is a value like another; extra columns pass through `epochs`, whatever their names. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARE, MOST, WEIGHTS = 1.5, 2.0, (5, 2, 1)
#: Rows that are sorted together, on average.
BUCKET = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds target to source, source_size, n, levels. The table has a row a source: its windows are over few rows."""
    by = F.col("source").asc_nulls_last()
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in WEIGHTS]), (F.pmod(F.row_number().over(W.orderBy(by)) - 1, F.lit(3)) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * MOST).withColumn("total", F.sum("source_size").over(every) * SHARE)
    # Sources fill up in order of cap / weight; those after a source share what is left once all before it are full.
    order = W.orderBy(F.col("source_size") / F.col("w"), by)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    levelled = ranked.withColumn("open", F.when(F.col("cap") > level * F.col("w"), level))
    # The water level is that of the first source that doesn't fill; without one, all are full.
    water = F.first("open", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levelled.withColumn("water", water).select("source", "source_size", "n", "levels", F.least("cap", F.coalesce(F.col("water") * F.col("w"), F.col("cap"))).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _level(quality: Column) -> Column:
    """Qualities on a scale of tenths of their logarithm: some thirty levels, from 1/21 to 1."""
    return F.round(F.log("quality"), 1)


def _keyed(docs: DataFrame, row: Column) -> DataFrame:
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>!", ""))
    quality = F.coalesce(1 / (1 + 20 * symbols / F.greatest(F.length("text"), F.lit(1))), F.lit(1.0))
    keyed = docs.select(row.cast("long").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("t"), quality.alias("quality")).withColumn("key", -F.log(_unit(F.lit(6), F.col("doc_id"), F.col("source"), F.col("t"))) / F.col("quality"))
    return keyed.withColumn("level", _level(F.col("quality")))


def mixed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, row (a number of the row, if one is given) for every row."""
    # The texts are read once: what follows works on a narrow table in the shared folder.
    rows = common.stored(_keyed(docs, F.lit(None) if row is None else row), "mix")
    levels = rows.groupBy("source", "level").agg(F.sum("size").alias("size"), F.count("*").alias("k"))
    sizes = levels.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("k").alias("n"), F.collect_list(F.struct(F.exp("level").alias("q"), F.col("k").cast("double").alias("k"))).alias("levels"))
    goals = common.stored(targets(sizes).withColumnRenamed("source", "_s"), "goals")
    small = rows.join(goals, rows.source.eqNullSafe(goals._s)).drop("_s")
    below = F.aggregate("levels", F.lit(0.0), lambda sum_, x: sum_ + x["k"] * (1 - F.exp(-x["q"] * F.col("key")))) / F.col("n")
    placed = small.withColumn("bucket", F.floor(below * F.ceil(F.col("n") / BUCKET))).drop("levels")
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = totals.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce("before", F.lit(0)).alias("before"))
    full = placed.join(before, placed.source.eqNullSafe(before._s) & (placed.bucket == before._b)).drop("_s", "_b")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "t", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = (F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before") - F.col("inside")))
    return full.withColumn("inside", inside).withColumn("epochs", epochs).withColumn("rest", rest).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "row")


def epochs(docs: DataFrame) -> DataFrame:
    """docs as the mix repeats them: a row for each complete epoch, and one for the part of the last; columns as before.

    The part of a document's words ends after the last of its taken words; the white space before it stays.
    """
    # Rows may repeat, so they are told apart by a number of their own; stored, for it must not change between reads.
    row, taken, size, take = common.fresh(docs.columns, "row", "taken", "size", "take")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    takes = mixed(numbered, F.col(row)).where("taken > 0").select(F.col("row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken))
    counts = F.concat(F.array_repeat(F.col(size), F.floor(F.col(taken) / F.col(size)).cast("int")), F.when(F.col(taken) % F.col(size) > 0, F.array(F.col(taken) % F.col(size))).otherwise(F.array().cast("array<bigint>")))
    rows = numbered.join(takes, row).withColumn(take, F.explode(counts))
    space = r"[\x20\x09-\x0D]+"
    text = F.col("text")
    leads = F.regexp_like(text, F.lit("^" + space)).cast("int")
    rest = F.element_at(F.split(text, space, F.col(take).cast("int") + 1 + leads), -1)
    cut = F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - F.length(rest)), space + "$", "")
    return rows.select(*[F.when(F.col(take) == F.col(size), text).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
