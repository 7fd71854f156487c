"""Evidence: segments, chunks, deduplication, embeddings and retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators.batches import each_text
from quarrystone.operators.picks import latest_per_key

CHUNK, OVERLAP, DIMENSIONS = 900, 120, 64
#: Queries and vectors of one block of a vector search.
ASKED, HELD = 4000, 32_000


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters, cut at the last paragraph, line, sentence or space of their second half."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". ", " "):
                at = text.rfind(mark, start + size // 2, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        left, right = start, end
        while left < right and text[left].isspace():
            left += 1
        while right > left and text[right - 1].isspace():
            right -= 1
        if right > left:
            out.append((left, right))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunked(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, start, stop, chunk) of every document: boundaries depend on those before, so Python finds them."""

    rows = lambda doc_id, text: [(doc_id, i, a, b, text[a:b]) for i, (a, b) in enumerate(split_text(text, size, overlap))]
    return each_text(docs, "doc_id", "text", rows, "doc_id long, chunk_index int, start int, stop int, chunk string")


def with_offsets(segments: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Where each segment begins when those of a key are joined by ``gap`` characters."""
    before = F.sum(F.length(text) + gap).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("start", F.coalesce(before, F.lit(0)).cast("bigint"))


def first_snapshots(snapshots: DataFrame, content_type: str, body: str, order: list) -> DataFrame:
    """The first row of each (content type, body), by a digest of both; ``n_same`` counts its like."""
    marked = snapshots.withColumn("fingerprint", F.sha2(F.concat_ws("\n", F.lit(content_type), F.col(body)), 256))
    counts = marked.groupBy("fingerprint").agg(F.count("*").alias("n_same"), F.min(F.struct(*order)).alias("first"))
    return counts.select("fingerprint", "n_same", "first.*")


def hashed_embedding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dimension, value): tokens hashed to signed dimensions, summed, with unit length."""
    each = df.select(key, F.explode(tx.tokens(F.col(text))).alias("token")).withColumn("digest", F.sha2("token", 256))
    dimension = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") % DIMENSIONS).cast("int")
    sign = F.when(F.conv(F.substring("digest", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = each.groupBy(key, dimension.alias("dimension")).agg(F.sum(sign).alias("total")).where("total <> 0")
    norms = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("total") * F.col("total")).cast("double")).alias("norm"))
    return sums.join(norms, key).select(key, "dimension", F.round(F.col("total") / F.col("norm"), 6).alias("value"))


def _matrix(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors as rows of a matrix, and which of them are there; the others are rows of NaN."""
    ids, lists = table.column(0).to_numpy(), table.column(column).combine_chunks()
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(ids), len(flat) // max(1, int(there.sum()))), np.nan)
    out[there] = flat.reshape(int(there.sum()), -1)
    return ids, out, there


def _candidates(asked: np.ndarray, held: np.ndarray, k: int, slack: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs among which every row of ``asked`` has its ``k`` + 1 best, by a product of matrices; what rounding could turn is taken in."""
    score = asked @ held.T
    score[np.isnan(score)] = np.inf  # ranks first, as Spark has it
    least = np.partition(score, -k - 1, 1)[:, -k - 1] if score.shape[1] > k + 1 else np.full(len(score), -np.inf)
    return np.nonzero(score >= least[:, None] - slack)


def _best(query: np.ndarray, asked: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the ``k`` best of each query, itself left out, equal ones by id."""
    order = np.argsort(ids, kind="stable")
    ids, held = ids[order], np.ascontiguousarray(held[order])
    # of vectors that are equal the first by id do: one more than asked for, since one may be the query itself
    _, same = np.unique(held.view(np.dtype((np.void, held.dtype.itemsize * held.shape[1]))).ravel(), return_inverse=True)
    by_copy = np.argsort(same, kind="stable")
    begins = np.searchsorted(same[by_copy], same[by_copy])
    kept = np.sort(by_copy[np.arange(len(same)) - begins <= k * np.bincount(np.unique(ids, return_inverse=True)[1]).max()])
    ids, held = ids[kept], held[kept]
    out = []
    for at in range(0, len(query), 256):
        q, v = _candidates(asked[at : at + 256], held, k * np.bincount(np.unique(ids, return_inverse=True)[1]).max())
        q += at
        q, v = (x[query[q] != ids[v]] for x in (q, v))
        for part in np.array_split(np.arange(len(q)), max(1, len(q) // 100_000)):
            a, b, total = asked[q[part]], held[v[part]], np.zeros(len(part))
            for d in range(held.shape[1]):
                total += b[:, d] * a[:, d]
            out.append((q[part], v[part], total))
    q, v, total = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((ids[v], np.where(np.isnan(total), -np.inf, -total), q))
    q, v, total = q[order], v[order], total[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query[q[first]], ids[v[first]], total[first]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = ASKED, held: int = HELD) -> DataFrame:
    """The ``k`` nearest vectors of each query by cosine, brute force.

    Vectors are brought to unit length once. Queries are dealt into blocks of some ``block``, vectors into blocks of some
    ``held``; every two blocks meet in a group of their own, where a product of matrices tells which pairs can be among
    the best. Only those are worked out term by term and ranked, and only the best ``k`` of each query leave the group.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("norm"))
    units = lambda df: df.where("vec_id IS NOT NULL").withColumn("norm", norm).select("vec_id", unit.alias("unit"))
    blocks = lambda df, size: max(1, -(-df.count() // size))
    n_asked, n_held = blocks(queries, block), blocks(vectors, held)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = units(queries).select("vec_id", "unit", own(n_asked).alias("_asked"), every(n_held).alias("_held"))
    given = units(vectors).select("vec_id", "unit", every(n_asked).alias("_asked"), own(n_held).alias("_held"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "cosine"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        (query, a, there), (ids, b, also) = _matrix(left, "unit"), _matrix(right, "unit")
        q, v, cosine = _best(query[there], a[there], ids[also], b[also], k) if there.any() and also.any() else (query[:0], ids[:0], np.zeros(0))
        # what has no vector has no cosine, and ranks last by id
        missing = [(x, y) for x in query[~there] for y in np.sort(ids)[: k + 1] if x != y] + [(x, y) for x in query[there] for y in np.sort(ids[~also])[: k + 1] if x != y]
        return pa.table([pa.array([*q, *(x for x, _ in missing)], pa.int64()), pa.array([*v, *(y for _, y in missing)], pa.int64()), pa.array([*cosine, *([None] * len(missing))], pa.float64())], names)

    scored = asked.groupBy("_asked", "_held").cogroup(given.groupBy("_asked", "_held")).applyInArrow(best, "query_id long, vec_id long, cosine double")
    return latest_per_key(scored, ["query_id"], [F.desc("cosine"), F.asc("vec_id")], k, "rank")


def retrieved(chunks: DataFrame, fields: DataFrame, keep: int = 5) -> DataFrame:
    """The best chunks of each field by words in common, phrases and the anchor; fields are a small table of hints."""
    words = F.size(F.array_intersect(F.array_distinct("tokens"), "hints"))
    phrases = F.size(F.filter("phrases", lambda p: F.col("lowered").contains(p)))
    score = F.least(F.lit(0.55), 0.12 * words) + F.least(F.lit(0.25), 0.12 * phrases) + F.when(F.col("anchor") == F.col("field"), 0.05).otherwise(0.0)
    pairs = chunks.crossJoin(F.broadcast(fields)).withColumn("score", F.round(F.least(F.lit(0.99), score), 4)).where("score > 0")
    return latest_per_key(pairs, ["field"], [F.desc("score"), F.asc("chunk_id")], keep, "rank")
