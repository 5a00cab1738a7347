"""What the corpus operators share: reading tables, words, shared storage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: `[^\x20\x09-\x0D]+` is a word. `bytes.split()` splits at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: The same words as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task takes, at most; the session's number of shuffle partitions is the least count.
SHARE = 64 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """How many ways to deal what comes of df: by the session's setting, and more if the size of df asks for it."""
    size = 0
    if df is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A plan that doesn't know its size says that it is huge.
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE) if size < 1 << 58 else 0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with so many lines before it that it clashes with none of columns, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lexigraph-"))
    return sc.getCheckpointDir()


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that any scheme works."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove_dir(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back.

    Parquet rather than checkpoint() where later steps read a few of the columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with copies that every executor can read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of each string, without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def arrow_schema(ddl: str) -> pa.Schema:
    """Only where a session is: on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def map_rows(df: DataFrame, schema: str, each: Callable[..., tuple], make: Callable[[], object] | None = None, rows: int = 512) -> DataFrame:
    """mapInArrow where `each(state, bytes..., )` makes one output row of one input row.

    Strings come as bytes. `make` builds a worker's state once a partition. Batches are cut into `rows` rows so that
    a few very long texts never stand in memory together with all of a batch's results.
    """

    arrow = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make() if make else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = [as_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in part.columns]
                out = [each(state, *row) for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def sample(df: DataFrame, limit: int, *key: str) -> DataFrame:
    """At most limit rows, those of the least hashes of key.

    A threshold from the count of rows comes first, so that no task sends limit rows to the driver.
    """
    h, = fresh(df.columns, "h")
    below = min(1.0, (1.1 * limit + 1000) / max(1, df.count()))
    hashed = df.withColumn(h, F.xxhash64(F.lit(77), *key)).where(F.pmod(F.col(h), F.lit(1 << 40)) < int(below * (1 << 40)))
    return hashed.orderBy(h, *key).limit(limit).drop(h)
