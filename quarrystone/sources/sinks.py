"""Sinks: snapshot replacement by partition, keyed merges, deletions, JSON artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.state import merged


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes ``df`` over the partitions that it holds, and leaves all others: a refresh can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merge_into(spark: SparkSession, updates: DataFrame, path: str, key: str, columns: list[str], overwrite: bool = True) -> str:
    """Upserts ``columns`` of ``updates`` into the Parquet at ``path``, as a new table beside it; returns the new one's path.

    All columns of the old table stay. Each merge has a path of its own, so readers of earlier ones keep their rows;
    whoever publishes the new path drops the old. One writer at a time is assumed.
    """
    old = spark.read.parquet(path)
    new_path = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    merged(old, updates, key, columns, overwrite).write.parquet(new_path)
    return new_path


def updated_from(df: DataFrame, repairs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` taken from the row of ``repairs`` of the same key, nulls among them; keys of ``repairs`` are unique."""
    new = repairs.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = df.join(new, df[key] == new["_key"], "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def changed_in_both(df: DataFrame, other: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One change set applied to two tables that share a key; it is written where it comes from, so both see the same."""
    return updated_from(df, changes, key, columns), updated_from(other, changes, key, columns)


def without(df: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those removed."""
    return df.join(removed.select(key), key, "left_anti")


def as_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
