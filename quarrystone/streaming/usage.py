"""Streaming counterparts: daily usage with late rows, duplicates within a watermark, merges by micro-batch.

The catalogue's own jobs run in batches; these offer the same results over a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: str = "*", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", files).parquet(folder)


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows and values of each day and type; a day is closed when the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def distinct(stream: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events without a gap longer than ``gap`` between them."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def into_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, in micro-batches; a repeated batch writes over itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
