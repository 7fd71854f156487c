"""Fields of candidates from the chunks of their pages: parsers in order, each field from the first that finds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import parsers

#: A separator that no text holds.
MARK = "\u0001"


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, parsers.ENDS, MARK), MARK), lambda s: F.trim(s) != "")


def extract(chunks: DataFrame, key: str, refused: DataFrame | None = None, requested: list[str] | None = None) -> DataFrame:
    """(key, field, value, step, chunk_id, quote) from ``chunks`` (key, family, chunk_id, chunk_index, text).

    Each sentence is read once by all parsers; a field's value is that of its earliest parser
    (step), and of that parser's sentences the first in the order of chunks. So what a label of
    the field itself says comes before what only hints at it, wherever both stand. Chunks in
    ``refused`` (chunk_id), such as those that name another product, say nothing.
    """
    own = chunks if refused is None else chunks.join(refused.select("chunk_id"), "chunk_id", "left_anti")
    each = own.where("text IS NOT NULL").select(F.col(key), "family", "chunk_id", "chunk_index", F.posexplode(sentences(F.col("text"))).alias("pos", "o")).withColumn("s", F.lower("o"))
    found = each.select(key, "chunk_id", "chunk_index", "pos", "o", F.explode(parsers.found()).alias("x")).select(key, "chunk_id", "chunk_index", "pos", "o", "x.*")
    if requested:
        found = found.where(F.col("field").isin(*requested))
    first = F.min(F.struct("step", "chunk_index", "pos", "chunk_id", "value", F.trim("o").alias("quote"))).alias("first")
    return found.groupBy(key, "field").agg(first).select(key, "field", "first.value", "first.step", "first.chunk_id", "first.quote")
