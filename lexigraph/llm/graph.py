"""Connected components as a plan: alternating large and small stars over an edge table, nothing on the driver but counts.

Once the edges are counted to be SMALL at most, one task finishes them by union-find, in memory that this count bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges that one task may finish; about 100 bytes each.
SMALL = 500_000


def _union_find(batches):
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(root)]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for each node of an edge (u, v: long). Loops and repeats are allowed."""
    e = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = common.checkpoint(e), None
    while True:
        if e.count() <= SMALL:
            return common.checkpoint(e.coalesce(1).mapInArrow(_union_find, "node long, label long"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").select("u", "v", "m")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = common.checkpoint(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
