"""The ingest pipeline as a file stream: new or changed files of a tree become chunks, batch by batch.

The batch function is the one that batch ingest uses; availableNow drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import Store


def stream(spark: SparkSession, folder: str, store: Store, library_id: str, version: str, out: str, checkpoint: str):
    """Starts the query; await its termination. Chunks land in `out` as Parquet, appended per batch."""
    source = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder).withColumn("path", F.col("_metadata.file_name"))

    def each(batch: DataFrame, number: int) -> None:
        rows = store.chunks(batch.select("path", F.col("value").alias("text")), library_id, version).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
