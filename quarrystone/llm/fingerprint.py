"""Document fingerprints, by DataFrame operations only.

SimHash: each term (two adjacent words, lower-cased) is hashed to 64 bits and votes on every
bit with its weight, which grows with its length; a bit is set if its votes for exceed those
against. The votes of two bits are counted in one 64-bit sum, 32 bits each, so a document
takes 32 sums, partially aggregated where its words are.

``within`` finds all fingerprints within a Hamming radius: fingerprints are cut into blocks,
and for every choice of blocks that as many differing bits must leave untouched there is a
table whose key is those blocks. Candidates that meet in several tables count in the first.

* A null text counts as empty; an empty text has one empty term. Equal texts have equal
  fingerprints. Texts and counts are in code points.
* The order of documents is by descending doc_id, null ids last, and equal ids by the hash of
  their text. A row that repeats another's id and text stands next to it: the next document of
  all such rows but one is their own text, and each has its row in the result. A single
  document is its own next one; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import written

RADIUS, BLOCKS = 3, 6
#: Ways in which documents with one fingerprint are spread where counts are handed to them.
SPREAD = 32
HEAVIEST = 4
TWO_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Adjacent words of a text, as an array of (a, b); the last word stands alone."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and fp: the fingerprint of each row's text. Keys tell rows apart."""
    each = rows.select(*keys, F.explode(terms(F.col(text))).alias("t")).select(*keys, F.col("t.a"), F.col("t.b"))
    each = each.select(*keys, F.xxhash64("a", "b").alias("x"), F.least(F.lit(HEAVIEST), 1 + F.floor((F.length("a") + F.coalesce(F.length("b"), F.lit(0))) / 4)).cast("long").alias("weight"))
    lanes = [F.sum(F.shiftrightunsigned("x", k).bitwiseAND(F.lit(TWO_LANES)) * F.col("weight")).alias(f"v{k}") for k in range(32)]
    votes = each.groupBy(*keys).agg(F.sum("weight").alias("all"), *lanes)
    bit = lambda n, place: F.when(n * 2 > F.col("all"), F.lit(1 << place if place < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    fp = F.lit(0).cast("long")
    for k in range(32):
        fp = fp.bitwiseOR(bit(F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k)).bitwiseOR(bit(F.shiftrightunsigned(f"v{k}", 32), k + 32))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and n (code points) of each document, and those of the document before it.

    The rows are light. They are range-sorted; a window runs within each range, and the ends of
    the ranges, one row for each, are handed to the ranges that follow.
    """
    light = docs.select("doc_id", "h", F.length("text").alias("n"))
    ranged = written(light.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("h").asc()).withColumn("part", F.spark_partition_id()), "order")
    place = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").asc())
    row = F.struct("doc_id", "h", "n")
    ranked = ranged.withColumn("at", F.row_number().over(place)).withColumn("before", F.lag(row).over(place))
    ends = ranked.groupBy("part").agg(F.max_by(row, "at").alias("end"))
    # as many rows as ranges: this is the one place where all of them meet
    last = F.max_by("end", "part").over(Window.partitionBy(F.lit(0)))
    heads = ends.select(F.col("part").alias("head_part"), F.coalesce(F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("part")), last).alias("head"))
    return ranked.join(heads, (ranked["part"] == heads["head_part"]) & (ranked["at"] == 1), "left").select("doc_id", "h", F.coalesce("before", "head").alias("to")).select("doc_id", "h", F.col("to.doc_id").alias("to_id"), F.col("to.h").alias("to_h"), F.col("to.n").alias("to_n"))


def with_copies(order: DataFrame, copies: DataFrame) -> DataFrame:
    """``order`` with how many rows each step stands for, ``n``: repeated rows (doc_id, h, copies) also step to themselves."""
    again = order.join(copies.withColumnsRenamed({"doc_id": "own_id", "h": "own_h"}), F.col("to_id").eqNullSafe(F.col("own_id")) & (F.col("to_h") == F.col("own_h")))
    again = again.select(F.col("to_id").alias("doc_id"), F.col("to_h").alias("h"), "to_id", "to_h", "to_n", (F.col("copies") - 1).alias("n"), F.lit(True).alias("again"))
    return order.select("*", F.lit(1).cast("long").alias("n"), F.lit(False).alias("again")).union(again)


def edited(docs: DataFrame, order: DataFrame) -> DataFrame:
    """doc_id, h, n, again, text and edited: the last third replaced by as many code points of the next document."""
    given = docs.join(order.withColumnsRenamed({"doc_id": "own_id", "h": "own_h"}), docs["doc_id"].eqNullSafe(F.col("own_id")) & (docs["h"] == F.col("own_h")))
    given = given.select("to_id", "to_h", "n", "again", F.expr("substring(text, 1, cast(to_n div 3 as int))").alias("piece"))
    kept = F.expr("substring(text, 1, cast(length(text) - length(text) div 3 as int))")
    return docs.join(given, docs["doc_id"].eqNullSafe(given["to_id"]) & (docs["h"] == given["to_h"])).select("doc_id", "h", "n", "again", "text", F.concat(kept, F.col("piece")).alias("edited"))


def tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, table and key: the blocks of each choice that ``radius`` differing bits can leave untouched."""
    keys = [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, mask in enumerate(masks(radius, blocks))]
    return prints.select("*", F.explode(F.array(*keys)).alias("k")).select(*prints.columns, "k.table", "k.key")


def cuts(blocks: int) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(radius: int, blocks: int) -> list[int]:
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts(blocks), cuts(blocks)[1:], strict=False)]
    return [signed(sum(own[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (q, fp) of distinct fingerprints: every ``fp`` of ``prints`` at ``radius`` bits or fewer of ``q``, a ``fp`` of ``queries``."""
    asked = tables(queries.select("fp").distinct(), radius, blocks).withColumnsRenamed({"fp": "q", "table": "q_table", "key": "q_key"})
    held = tables(prints.select("fp").distinct(), radius, blocks)
    apart = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(mask)) == 0, F.lit(t)) for t, mask in enumerate(masks(radius, blocks))])
    # a query has as many rows here as there are tables, which Spark's sizes don't show: no side is broadcast
    return held.hint("merge").join(asked, (F.col("table") == F.col("q_table")) & (F.col("key") == F.col("q_key")) & (F.bit_count(apart) <= radius) & (first == F.col("table"))).select("q", "fp")


def compare(docs: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near.

    n_near is the number of documents, itself included, whose fingerprints lie within
    ``radius`` bits of its own; it is asked for documents whose id ``every`` divides, and null
    for the others.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    copies = written(own.groupBy("doc_id", "h").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    # each step below takes a row once; ``n`` says for how many it stands
    own = own.dropDuplicates(["doc_id", "text"]) if copies.limit(1).count() else own
    order = written(with_copies(in_order(own), copies), "next")
    both = edited(own, order).select("doc_id", "h", "n", "again", F.length("text").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("t"))
    keys = ["doc_id", "h", "n", "again", "n_chars", "sha", "which"]
    prints = written(simhash(both.select(*keys[:6], "t.which", "t.body"), keys, "body"), "prints")
    pair = prints.groupBy(*keys[:6]).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    pair = written(pair, "pairs")
    following = pair.where("not again").join(order.where("not again").select(F.col("doc_id").alias("own_id"), F.col("h").alias("own_h"), "to_id", "to_h"), pair["doc_id"].eqNullSafe(F.col("own_id")) & (pair["h"] == F.col("own_h"))).select("to_id", "to_h", F.col("fp").alias("next_fp"))
    counts = pair.groupBy("fp").agg(F.sum("n").alias("n"))
    asked = pair.where(F.col("doc_id") % every == 0)
    near = within(counts, asked, radius).join(counts, "fp").groupBy("q").agg(F.sum("n").alias("n_near"))
    # very many documents may ask with one fingerprint: its count is handed out in several places
    near = near.select("q", "n_near", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    dealt = asked.where("not again").select("doc_id", "h", "fp", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("spread"))
    found = dealt.join(near, (F.col("fp") == F.col("q")) & (F.col("spread") == F.col("part"))).select(F.col("doc_id").alias("near_id"), F.col("h").alias("near_h"), "n_near")
    out = pair.join(following, pair["doc_id"].eqNullSafe(following["to_id"]) & (pair["h"] == following["to_h"]))
    out = out.join(found, (out["doc_id"] == found["near_id"]) & (out["h"] == found["near_h"]), "left")
    out = out.withColumn("next_fp", F.when(F.col("again"), F.col("fp")).otherwise(F.col("next_fp"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_near")
