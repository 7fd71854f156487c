"""Work that is done once: pages are parsed for each parser version, and what was parsed is read again.

Results lie in folders by parser version. A run reads the keys of its own version alone (Spark
prunes the other folders and reads no other column), takes the snapshots that aren't among
them, and adds theirs. The writer's commit makes a run's files visible at its end, so a lost
executor or a failed run leaves nothing half done; a run that is repeated finds its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import sections
from quarrystone.operators.batches import each_text
from quarrystone.operators.lineage import kept

STORE = "snapshot_id string, section_index int, anchor string, text string, start int, stop int, parser_version string"


def snapshots(pages: DataFrame) -> DataFrame:
    """(page_id, snapshot_id, html): a snapshot is named by its content; a null page is an empty one."""
    return pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("snapshot_id"), F.coalesce("html", F.lit("")).alias("html"))


def parsed(spark: SparkSession, store: str) -> DataFrame:
    """What lies in ``store``; nothing where no run has written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(STORE).option("basePath", store).parquet(store) if there else spark.createDataFrame([], STORE)


def parse(pages: DataFrame, store: str, version: str) -> DataFrame:
    """Parses the snapshots of ``pages`` that ``store`` doesn't have for ``version``; returns (page_id, snapshot_id, action), action being stored or reused.

    Pages of equal content are one snapshot, parsed once. A page without sections is kept as one
    empty section, so that it isn't parsed again.
    """
    taken = snapshots(pages)
    known = kept(parsed(pages.sparkSession, store).where(F.col("parser_version") == version).select("snapshot_id").distinct(), "parsed")
    # what is known is fixed before anything is added, so the actions don't change when they are read later
    fresh = taken.join(known, "snapshot_id", "left_anti").groupBy("snapshot_id").agg(F.min_by("html", "page_id").alias("html"))
    rows = lambda snapshot_id, html: sections.rows_of(snapshot_id, html) or [(snapshot_id, 0, "", "", 0, 0)]
    read = each_text(fresh, "snapshot_id", "html", rows, "snapshot_id string, section_index int, anchor string, text string, start int, stop int")
    read.withColumn("parser_version", F.lit(version)).write.mode("append").partitionBy("parser_version").parquet(store)
    action = F.when(F.col("reused"), "reused").otherwise("stored")
    return taken.select("page_id", "snapshot_id").join(known.withColumn("reused", F.lit(True)), "snapshot_id", "left").select("page_id", "snapshot_id", action.alias("action"))
