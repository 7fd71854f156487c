"""Published snapshots and objects: executors write under a key of the content, then one small pointer is put in place.

Readers follow the pointer, so they see all of a snapshot or all of the one before. A snapshot
is known by its content: to publish the same rows again writes nothing. Spark's commit makes a
snapshot's files visible at once, so a lost executor's task is repeated and leaves nothing
beside the result; a publisher that fails before the pointer leaves the old one in force.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published contents whose files stay, the current one among them.
HISTORY = 2
POINTER = "CURRENT.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def content_key(df: DataFrame) -> str:
    """A key of the rows of ``df``, whatever their order: columns and types, how many rows, and sums of two hashes of each."""
    columns = sorted(df.columns)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
    sums = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("a"), F.sum(F.col("b").cast("decimal(20,0)")).alias("b")).first()
    told = json.dumps([[f.name, f.dataType.simpleString()] for f in sorted(df.schema.fields, key=lambda f: f.name)]) + f"|{sums.n}|{sums.a}|{sums.b}"
    return df.sparkSession.range(1).select(F.sha2(F.lit(told), 256)).first()[0][:32]


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What is published at ``root``: content, path, schema, rows and history; None before the first time."""
    fs, path = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])


def _point(spark: SparkSession, root: str, told: dict) -> None:
    """Puts the pointer in place by one rename that replaces the old one."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, temporary = _fs(spark, f"{root}/.{uuid.uuid4().hex}.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, options)


def publish(df: DataFrame, root: str, keep: int = HISTORY) -> dict:
    """Publishes the rows of ``df`` at ``root``; returns the pointer, with ``written`` telling whether files were new.

    ``df`` is worked out twice, for its key and for its files, so it has to give the same rows
    each time; read it from tables, or write it first. Files of older contents go when the
    pointer is in place, but for the last ``keep``.
    """
    spark = df.sparkSession
    key = content_key(df)
    path = f"{root}/content-{key}"
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    written = not fs.exists(done)
    if written:
        df.write.mode("overwrite").parquet(path)  # what an earlier, failed writer left is written over
    before = pointer(spark, root)
    history = [key, *(k for k in (before or {}).get("history", []) if k != key)]
    told = {"content": key, "path": path, "schema": df.schema.json(), "history": history[:keep]}
    _point(spark, root, told)
    for old in history[keep:]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/content-{old}"), True)
    return told | {"written": written}


def published(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The rows that the pointer at ``root`` names, or those published ``back`` contents before."""
    from pyspark.sql.types import StructType

    told = pointer(spark, root)
    if told is None or back >= len(told["history"]):
        raise FileNotFoundError(f"nothing is published at {root}")
    if back == 0:
        return spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(told["path"])
    return spark.read.parquet(f"{root}/content-{told['history'][back]}")


def put(objects: DataFrame, store: str) -> DataFrame:
    """Adds the bodies of ``objects`` (key, body) to ``store`` under their digests, each content once; returns (key, digest, size).

    Digests that are there already aren't written again. Folders are named by a digest's first
    digit, so a reader that knows what it wants opens a part of them.
    """
    spark = objects.sparkSession
    given = objects.select("key", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("size"), "body").where("body IS NOT NULL")
    fs, path = _fs(spark, store)
    new = given.groupBy("digest").agg(F.min("body").alias("body"))
    if fs.exists(path):
        new = new.join(stored(spark, store).select("digest"), "digest", "left_anti")
    new.withColumn("shard", F.substring("digest", 1, 1)).write.mode("append").partitionBy("shard").parquet(store)
    return given.drop("body")


def stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("digest string, body binary, shard string").parquet(store)


def get(spark: SparkSession, store: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (digest, ...) with the body of each digest; null for one that isn't there."""
    shard = F.substring("digest", 1, 1)
    return wanted.withColumn("shard", shard).join(stored(spark, store), ["shard", "digest"], "left").drop("shard")
