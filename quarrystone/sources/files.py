"""Registries and objects from files, and relations that are empty by design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a registry file holds, one JSON object over many lines.
REGISTRY = "registry_version string, bank_code string, country_code string, product_type string, entry_source_id string, sources array<struct<source_id: string, url: string, source_type: string, discovery_role: string>>"


def registries(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of all registry files below ``path``, with its registry's codes."""
    return spark.read.schema(REGISTRY).json(path, multiLine=True).select("registry_version", "bank_code", "country_code", "product_type", "entry_source_id", F.inline("sources"))


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, body) of the objects below ``path``; keys are relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.substring_index("path", path.rstrip("/") + "/", -1).alias("key"), F.col("content").alias("body"))


def discarded(spark: SparkSession, schema: str) -> DataFrame:
    """A relation that keeps its columns and no rows: what stood there is written no more."""
    return spark.createDataFrame([], schema)
