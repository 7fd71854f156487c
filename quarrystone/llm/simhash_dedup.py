"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ at
two bits or fewer, one segment differs at one bit at most. So each segment is indexed under
its 32 variants with one wildcard bit; two such fingerprints meet in an equality join on a
variant, and the join's pairs are verified by counting bits.

A variant that very many fingerprints share is not paired. Its fingerprints are indexed once
more, with wildcards in the other segment too; a group then holds four fingerprints at most,
all within two bits of each other, and a star joins it. No link between fingerprints is lost
to a link path by either way, since stars have the same components as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import sliced, texts_of, unused, written
from quarrystone.llm.graph import components

WORDS, SEED = 3, 42
#: Fingerprints of one variant up to which all pairs are verified.
PAIRED = 256
#: Fingerprints whose variants one task makes and counts: 64 rows each.
PER_TASK = 16_000
#: Ways in which documents with one fingerprint are spread for the last join.
SPREAD = 32
LANES = np.uint64(0x0101010101010101)


def votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each document have each bit: (documents, 64). No document is empty.

    Bits are counted in eight byte lanes of a word at once, over runs of 255 hashes.
    """
    ends = np.append(starts[1:], len(hashes))
    runs = -(-(ends - starts) // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    counts = np.empty((len(at), 8, 8), np.int64)
    for bit in range(8):
        counts[:, :, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, at).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, 64), first, axis=0)


def shingles(text: bytes) -> list[bytes]:
    words = text.lower().split()
    if len(words) < WORDS:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)))


def simhashes(texts: Iterator[bytes]) -> Iterator[int]:
    """The fingerprint of each text, as a signed number; zero where there is no word."""
    block, sizes = [], []

    def flush() -> list[int]:
        size = np.asarray(sizes)
        out = np.zeros(len(size), np.int64)
        full = size > 0
        if full.any():
            hashes, size = np.concatenate(block), size[full]
            ones = votes(hashes, np.cumsum(size) - size) * 2 > size[:, None]
            out[full] = np.packbits(ones.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0].view(np.int64)
        block.clear()
        sizes.clear()
        return out.tolist()

    waiting = 0
    for text in texts:
        own = shingles(text)
        block.append(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)))
        sizes.append(len(own))
        waiting += len(own)
        if waiting > 200_000:
            yield from flush()
            waiting = 0
    yield from flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(simhashes(texts_of(b.column(1)))), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, fp long")


def bits_apart(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


#: A variant's number, 0 to 63, above its segment's value without the wildcard bit.
VARIANT = "shiftleft(cast(i as bigint), 32) | (if(i < 32, shiftrightunsigned(fp, 32), fp & 4294967295L) & ~shiftleft(1L, i % 32))"
OTHER = "if(i < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))"


def links(prints: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that have the components of all links of 2 bits or fewer."""
    prints = prints.select("fp").repartition(max(1, -(-prints.count() // PER_TASK)))
    index = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", "i", F.expr(VARIANT).alias("variant"))
    shared = written(index.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    twos = shared.where("n = 2").select("a", "b")
    # the list of shared variants grows with the documents: it is shuffled at every size
    more = written(index.hint("merge").join(shared.where("n > 2").select("variant", "n"), "variant"), "shared-variants")
    few = more.where(F.col("n") <= paired).select("variant", "i", F.col("fp").alias("a"))
    # of the variants that a pair shares, one stands for it: that of the bit at which the segment differs, or else of its lowest
    apart = F.expr("if(i < 32, shiftrightunsigned(a ^ b, 32), (a ^ b) & 4294967295L)")
    meets = (F.col("variant") == F.col("other")) & F.expr("a < b") & (bits_apart("a", "b") <= 2) & (apart.isin(0) & F.expr("i % 32 = 0") | (apart == F.expr("shiftleft(1L, i % 32)")))
    pairs = few.join(few.select(F.col("variant").alias("other"), F.col("a").alias("b")), meets).select("a", "b")
    many = more.where(F.col("n") > paired).select("fp", "i", "variant", F.expr(OTHER).alias("rest"))
    one = many.select("fp", "variant", "rest", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j")).select("fp", F.struct("variant", "j", F.expr("rest & ~shiftleft(1L, j)").alias("rest")).alias("key"))
    # where one segment is equal, all its 32 variants are shared: that of the lowest bit stands for them
    two = (
        many.where("i % 32 = 0")
        .select("fp", "i", "rest", F.explode(F.expr("flatten(transform(sequence(0, 30), j -> transform(sequence(j + 1, 31), k -> j * 32 + k)))")).alias("jk"))
        .select("fp", F.struct(F.expr("if(i < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)").alias("variant"), (F.col("i") * 1024 + F.col("jk") + 32).alias("j"), F.expr("rest & ~shiftleft(1L, cast(jk / 32 as int)) & ~shiftleft(1L, jk % 32)").alias("rest")).alias("key"))
    )
    stars = one.union(two).groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.collect_set("fp").alias("all")).where("a < b").select("a", F.explode("all").alias("b")).where("a < b")
    return twos.union(pairs).union(stars).where(bits_apart("a", "b") <= 2).distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row. ``root`` tells components apart that have the same smallest id."""
    own = written(fingerprints(docs), "fingerprints")
    prints = written(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "prints")
    roots = written(components(written(links(prints.select("fp")), "links")), "roots")
    linked = roots.join(prints, roots["node"] == prints["fp"]).select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    groups = (
        prints.join(named, "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "n", "least")
        .where("n > 1 or component_id <> least or least is null or root <> fp")
        .select("fp", "root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    )
    spread = own.withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int"))
    return spread.join(groups, ["fp", "spread"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents with one fingerprint are linked without pairing them. A null doc_id never
    names a component unless all its documents have none; repeated rows are repeated in the
    result; an empty table gives no rows. Other columns are not read.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def printed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with their fingerprints in column ``name``."""
    names = [*docs.columns, name]
    at = names.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(simhashes(texts_of(b.column(at)))), pa.int64())], names)

    return docs.mapInArrow(of, docs.select("*", F.lit(None).cast("long").alias(name)).schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component, one for each; a component without ids keeps its rows.

    Rows are found again by id and fingerprint, so an id on texts of several components keeps
    one row in each. Of rows that share their component's id, that of least fingerprint and
    text stays.
    """
    found = written(grouped(docs), "near-duplicates")
    kept_id, kept_fp, kept_n, own_fp, place = unused(docs, "kept_id", "kept_fp", "kept_n", "own_fp", "kept_place")
    named = found.where("component_id = doc_id").groupBy("root", "doc_id").agg(F.min("fp").alias("fp"), F.count("*").alias("n")).select("doc_id", "fp", "n")
    unnamed = found.where("component_id is null").select("doc_id", "fp", F.lit(1).cast("long").alias("n")).distinct()
    keepers = written(named.union(unnamed).toDF(kept_id, kept_fp, kept_n), "keepers")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own_fp) == F.col(kept_fp))
    kept = printed(docs, own_fp).join(keepers, same)
    if keepers.where(F.col(kept_n) > 1).limit(1).count():
        first = Window.partitionBy(kept_id, kept_fp).orderBy("text")
        alone, several = kept.where(F.col(kept_n) == 1).withColumn(place, F.lit(1)), kept.where(F.col(kept_n) > 1).withColumn(place, F.row_number().over(first))
        kept = alone.union(several).where(F.col(place) == 1)
    return kept.select(*docs.columns)
