"""The engine's own tables: ingest, removal, vectorising, splitting.

libraries is small and rewritten under a new stamp; the newest stamp whose write was committed is the table, so a reader
never finds none. snippets, bands, postings, doc_stats and totals are partitioned by library and version: an ingest
overwrites the partitions it touches and no others, so it can be repeated, and what was there stays until the new rows are.
Ids go up from a mark that removals leave as it is, so none is used twice. A written index follows ingests and removals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalog, chunking, index, parsing, semantic
from .providers import Embedder, embedding

LIBRARIES = "id string, version string, title string, description string, source_repo string, total_snippets long, trust_score double, benchmark_score double, ingested_at timestamp, ingest_seq long"
SNIPPETS = "id long, title string, content string, source_path string, source_url string, language string, token_count int, breadcrumb string, embedding array<float>, library_id string, library_version string"
_KEYS = ("library_id", "library_version")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and rows of old with other keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def without(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) != value)


def numbered(rows: DataFrame, by: list[str], base: int, group: str) -> DataFrame:
    """A column id from base + 1 on, in order of `by` inside each group.

    No task sees more than one group's rows, but the one that adds up the groups' counts, a row a group.
    """
    offsets = rows.groupBy(group).count().withColumn("_offset", F.coalesce(F.sum("count").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return rows.join(offsets, group).withColumn("id", F.row_number().over(W.partitionBy(group).orderBy(*by)) + F.col("_offset") + base).drop("_offset")


class Store:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def exists(self, table: str) -> bool:
        return self._fs.exists(self._p(table))

    def _stamps(self) -> list[str]:
        """Committed tables of libraries, oldest first."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._p(""))] if self._fs.exists(self._p("")) else []
        return sorted(n for n in found if n.startswith("libraries-") and self.exists(f"{n}/_SUCCESS"))

    def _pointer(self) -> str | None:
        return (self._stamps() or [None])[-1]

    def libraries(self) -> DataFrame:
        now = self._pointer()
        return self.spark.read.schema(LIBRARIES).parquet(f"{self.path}/{now}") if now else self.spark.createDataFrame([], LIBRARIES)

    def _put_libraries(self, rows: DataFrame) -> None:
        old = self._pointer()
        stamp = f"libraries-{int(old.rsplit('-', 1)[1]) + 1 if old else 1:08d}"
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{stamp}")
        for name in self._stamps()[:-2]:  # the one before stays for readers that have begun
            self._fs.delete(self._p(name), True)

    def _mark(self) -> int:
        """The highest id that was ever given."""
        said = self.spark.read.text(f"{self.path}/IDS").first()[0] if self.exists("IDS") else 0
        return max(int(said), self.snippets().agg(F.max("id")).first()[0] or 0)

    def _set_mark(self, value: int) -> None:
        out = self._fs.create(self._p("IDS"), True)
        out.write(bytearray(str(value).encode()))
        out.close()

    def index_path(self, profile: str = "plain") -> str | None:
        """The written index, if there is one."""
        return f"{self.path}/index-{profile}" if self.exists(f"index-{profile}/postings") else None

    def snippets(self) -> DataFrame:
        return self.spark.read.schema(SNIPPETS).parquet(f"{self.path}/snippets") if self.exists("snippets") else self.spark.createDataFrame([], SNIPPETS)

    def bands(self) -> DataFrame:
        schema = "snippet_id long, band1 int, band2 int, band3 int, band4 int, library_id string, library_version string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/bands") if self.exists("bands") else self.spark.createDataFrame([], schema)

    def _overwrite(self, rows: DataFrame, table: str) -> None:
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*_KEYS).parquet(f"{self.path}/{table}")

    def _drop(self, table: str, library_id: str, version: str | None = None) -> None:
        esc = lambda s: self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(s)
        path = self._p(f"{table}/library_id={esc(library_id)}" + (f"/library_version={esc(version)}" if version else ""))
        self._fs.delete(path, True)

    def chunks(self, files: DataFrame, library_id: str, version: str, **options) -> DataFrame:
        """What an ingest of files (path, text) would write, without ids and embeddings."""
        rows = chunking.chunked(parsing.parsed(files).select(F.col("path").alias("source_path"), "sections"), **options)
        lib = F.lit(library_id)
        return rows.withColumns({"library_id": lib, "library_version": F.lit(version), "source_url": T.source_url(lib, F.col("source_path"), F.lit(version)), "language": F.coalesce("language", F.lit(""))})

    def ingest(self, files: DataFrame, repo: str, version: str = "latest", title: str = "", description: str = "", provider: Embedder | None = None, **options) -> int:
        """Replaces a library's version. Returns the number of its snippets."""
        library_id = self.spark.range(1).select(T.library_id(F.lit(repo))).first()[0]
        base = self._mark()
        rows = numbered(self.chunks(files, library_id, version, **options), ["chunk_no"], base, "source_path")
        vector = embedding(F.col("content"), provider) if provider else F.lit(None).cast("array<float>")
        rows = rows.withColumn("embedding", vector).select(*[f.strip().split(" ")[0] for f in SNIPPETS.split(",")])
        self._overwrite(rows, "snippets")
        own = self.snippets().where((F.col("library_id") == library_id) & (F.col("library_version") == version) & (F.col("id") > base))
        count = own.count()
        if provider and count:
            self._overwrite(semantic.with_bands(own, provider.dims), "bands")
        else:
            self._drop("bands", library_id, version)
        for profile in ("plain", "porter"):
            if path := self.index_path(profile):
                for table in ("postings", "doc_stats", "totals") if not count else ():
                    self._drop(f"index-{profile}/{table}", library_id, version)
                if count:
                    index.write(own, path, profile)
        if count:
            self._set_mark(base + count)
        else:  # nothing to put in place of what was there
            self._drop("snippets", library_id, version)
        old = self.libraries()
        seq = (old.agg(F.max("ingest_seq")).first()[0] or 0) + 1
        new = self.spark.range(1).select(
            F.lit(library_id).alias("id"), F.lit(version).alias("version"), F.lit(title or library_id).alias("title"), F.lit(description).alias("description"), F.lit(repo).alias("source_repo"),
            F.lit(count).cast("long").alias("total_snippets"), F.lit(5.0).alias("trust_score"), F.lit(0.0).alias("benchmark_score"), F.current_timestamp().alias("ingested_at"), F.lit(seq).cast("long").alias("ingest_seq"),
        )
        self._put_libraries(upserted(old, new, ["id", "version"]))
        return count

    def remove(self, library_id: str, cascade: bool = True) -> int:
        """Removes all versions of a library; with cascade its snippets and index rows too. Returns how many versions went."""
        old = self.libraries()
        n = old.where(F.col("id") == library_id).count()
        if n:
            self._put_libraries(without(old, "id", library_id))
        if cascade:
            for profile in ("plain", "porter"):
                for table in ("postings", "doc_stats", "totals") if self.index_path(profile) else ():
                    self._drop(f"index-{profile}/{table}", library_id)
            self._set_mark(self._mark())
            for table in ("snippets", "bands"):
                self._drop(table, library_id)
        return n

    def vectorize(self, provider: Embedder, library_id: str | None = None, version: str | None = None, force: bool = False) -> int:
        """Embeds rows without embedding (all with force) and fills in band rows. Returns how many now have a new embedding."""
        rows = semantic.scope(self.snippets(), library_id, version)
        todo = F.lit(True) if force else F.col("embedding").isNull()
        touched = rows.where(todo).select(*_KEYS).distinct()
        new = rows.join(F.broadcast(touched), list(_KEYS), "left_semi").withColumn("_todo", todo)
        made = new.withColumn("_new", embedding(F.when(F.col("_todo"), F.col("content")), provider)).withColumn("embedding", F.when(F.col("_todo"), F.col("_new")).otherwise(F.col("embedding")))
        # The table can't be read and overwritten in one job.
        staged = f"{self.path}/staged"
        made.write.mode("overwrite").parquet(staged)
        done = self.spark.read.parquet(staged)
        count = done.where("_todo and _new is not null").count()
        columns = [f.strip().split(" ")[0] for f in SNIPPETS.split(",")]
        self._overwrite(done.select(*columns), "snippets")
        self._overwrite(semantic.with_bands(done.select(*columns), provider.dims), "bands")
        self._fs.delete(self._p("staged"), True)
        return count

    def reindex(self, profile: str = "plain") -> None:
        """Rebuilds postings and document lengths from the snippets as they are."""
        self._fs.delete(self._p(f"index-{profile}"), True)
        index.write(self.snippets(), f"{self.path}/index-{profile}", profile)

    def orphans(self) -> DataFrame:
        """Library versions that have snippets and no catalog row."""
        keys = self.libraries().select(F.col("id").alias("library_id"), F.col("version").alias("library_version"))
        return self.snippets().select(*_KEYS).distinct().join(keys, list(_KEYS), "left_anti")

    def split(self, out: str, domains: dict[str, list[str]]) -> DataFrame:
        """Writes libraries and snippets by domain, all versions; returns the domains' figures."""
        domain = lambda c: T.domain_of(F.col(c), domains)
        self.libraries().withColumn("domain", domain("id")).where("domain is not null").write.mode("overwrite").partitionBy("domain").parquet(f"{out}/libraries")
        own = self.snippets().withColumn("domain", domain("library_id")).where("domain is not null")
        own.write.mode("overwrite").partitionBy("domain").parquet(f"{out}/snippets")
        return catalog.domain_stats(self.snippets(), domains)
