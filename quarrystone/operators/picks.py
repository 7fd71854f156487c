"""Ordered picks, gated rankings, shares and paging: what the catalogue's queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``. Catalyst limits each task's rows before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= keep)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def placed(df: DataFrame, key: str, order: str, head: int = 5) -> DataFrame:
    """``df`` with ``place``, from 0 in each key's order of a text, and ``n``, the rows of the key; a key may have any number of rows.

    Rows are ranked among those whose texts begin alike; what lies before them is a sum over the few counts of beginnings.
    """
    marked = df.withColumn("_head", F.substring(order, 1, head))
    own = Window.partitionBy(key).orderBy("_head")
    counts = marked.groupBy(key, "_head").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy(key))).drop("_n")
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(key, "_head").orderBy(order)))
    return ranked.join(counts, [key, "_head"]).withColumn("place", F.col("_before") + F.col("_rank") - 1).drop("_head", "_before", "_rank")


def ranking(df: DataFrame, order: list[Column], size: int = 5, least: int = 3) -> DataFrame:
    """The first ``size`` rows with their rank, or none where fewer than ``least`` are there.

    The top rows are found by partial top-k and only they meet in one task.
    """
    top = df.orderBy(*order).limit(max(size, least))
    one = Window.partitionBy(F.lit(0))
    return top.withColumn("rank", F.row_number().over(one.orderBy(*order))).withColumn("_n", F.count("*").over(one)).where((F.col("_n") >= least) & (F.col("rank") <= size)).drop("_n")


def or_top(df: DataFrame, test: Column, order: list[Column], size: int, instead: int) -> DataFrame:
    """The first ``size`` rows that pass a test, as warnings; where none does, the first ``instead`` of all, as information."""
    found = df.where(test).orderBy(*order).limit(size).withColumn("signal", F.lit("warning"))
    others = df.orderBy(*order).limit(instead).withColumn("signal", F.lit("info"))
    return found.unionByName(others.join(F.broadcast(found.agg(F.count("*").alias("_n"))), F.col("_n") == 0).drop("_n"))


def breakdown(df: DataFrame, code: str) -> DataFrame:
    """code, n and share_percent of the total (halves to even), for the non-blank values of a column."""
    counts = df.where(F.col(code).isNotNull() & (F.col(code) != "")).groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("code", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 2).alias("share_percent"))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of rows, each with total, total_pages and has_next."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / F.lit(size)).cast("bigint")
    return rows.crossJoin(F.broadcast(total)).withColumn("total_pages", pages).withColumn("has_next", F.lit(number) < pages)


def searched(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with ``needle`` in one of ``columns``, whatever the case; its characters are literal."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(F.col(c)).contains(needle.strip().lower()), F.lit(False))
    return df.where(test)


def optional(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows whose columns are in the given lists; an empty list lets all rows pass."""
    for column, values in wanted.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def binned(value: Column, limits: list[tuple[float, str]], above: str) -> Column:
    """The label of the first limit that ``value`` is below; (0, label) stands for zero and less."""
    out = None
    for limit, label in limits:
        test = value <= 0 if limit == 0 else value < limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(value.isNotNull(), out.otherwise(above))


def changed_since(df: DataFrame, day: str, anchor: str, days: int = 30) -> Column:
    """Whether ``day`` lies in the ``days`` before ``anchor``, both ends included; never by the wall clock."""
    return F.col(day).between(F.date_sub(F.lit(anchor).cast("date"), days), F.lit(anchor).cast("date"))
