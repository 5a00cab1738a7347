"""Scans of documentation trees: scan specification to reader options, files to rows."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DEFAULT_GLOB = "*.{md,mdx,markdown,rst,txt}"
_GLOB = set("*?[]{}!")


@dataclass(frozen=True)
class Scan:
    """Folder, file-name pattern, and the path from the tree's root to the folder."""

    folder: str
    pattern: str
    prefix: str = ""


def resolve(root: str, docs_path: str | None = None) -> Scan:
    """Nothing: the whole tree. A pattern: from the root. A file: it alone. A folder, or what is not there: that folder."""
    path = (docs_path or "").replace("\\", "/").strip("/")
    if not path:
        return Scan(root, DEFAULT_GLOB)
    if _GLOB & set(path):
        return Scan(root, path)
    full = os.path.join(root, path)
    if os.path.isfile(full):
        return Scan(os.path.dirname(full), os.path.basename(full), os.path.dirname(path))
    return Scan(full, DEFAULT_GLOB, path)


def files(spark: SparkSession, scan: Scan) -> DataFrame:
    """path (from the tree's root, with forward slashes) and text of each file, bytes that aren't UTF-8 replaced.

    A missing folder gives no rows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(scan.folder)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, text string")
    name = scan.pattern.rsplit("/", 1)[-1]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(scan.folder)
    base = F.lit(scan.folder.rstrip("/").split("://")[-1].removeprefix("file:") + "/")
    inner = F.element_at(F.split(F.col("path"), base, 2), -1)
    out = rows.select(F.concat_ws("/", *([F.lit(scan.prefix)] if scan.prefix else []), inner).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    folder = scan.pattern.rsplit("/", 1)[0] if "/" in scan.pattern else ""
    if folder and folder.replace("*", ""):  # folders of a pattern: ** any depth, * one level
        regex = "^" + folder.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", "[^/]") + "/"
        out = out.where(F.col("path").rlike(regex))
    return out.withColumn("path", T.posix_path(F.col("path")))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, Scan(folder, "*.md"))


def clone(url: str, into: str, version: str | None = None) -> str:
    """Clones a repository (one commit of a branch or tag) into a folder that driver and executors share; git's own error is raised."""
    done = subprocess.run(["git", "clone", "--quiet", "--depth", "1", *(["--branch", version] if version else []), "--", url, into], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
    return into
