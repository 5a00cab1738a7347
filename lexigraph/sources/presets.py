"""The preset registry: a JSON object of name to repository, documentation path, title, description and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "struct<repo: string, docsPath: string, title: string, description: string, versions: array<string>>"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """name, repo, docs_path, title, description, versions; by name, any case."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"map<string, {_ENTRY}>")).alias("name", "p"))
    return rows.select("name", "p.repo", F.col("p.docsPath").alias("docs_path"), "p.title", "p.description", "p.versions").orderBy(F.lower("name"), "name")


def get(spark: SparkSession, path: str, name: str):
    """The preset of exactly that name, or None."""
    return listed(spark, path).where(F.col("name") == name).first()
