"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import drop_path, shared_path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), long; root is the smallest node reachable.

    Kiveris et al., "Connected components in MapReduce and beyond" (2014). Each half round
    moves edges towards smaller nodes and is written to the shared folder, which ends the
    lineage; it stops when a round changes nothing. Minima are taken with partial
    aggregation, so a node with very many neighbours costs no more than its edges, and the
    join that hands a node's minimum to its edges is one that Spark splits when skewed.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "stars")
        df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    def sums(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first())

    own, path = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, before = sums(own), None
    while state != before and state[0]:
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large, large_path = keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        own, small_path = keep(small)
        drop_path(spark, large_path)
        drop_path(spark, path)
        path, before, state = small_path, state, sums(own)
    roots = own.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(own.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
