"""Target-distribution importance resampling over hashed n-grams.

Documents are drawn with odds that liken the corpus to a target: an n-gram's bucket counts by
how much commoner it is in the target texts than in the corpus. Features are found by suffix
arrays of word ids: the places of a block of a partition are sorted by the words that follow,
places that share their first words lie in one run of common prefixes, each run is one
distinct n-gram and is hashed once, and its bucket goes back to all places of the run.

* Both passes (counts, scores) read every text whole; counts of the buckets are added up in
  each task before they are shuffled, so at most ``BUCKETS`` rows leave a task.
* The draw is exact: scored rows are range-sorted by score, numbered within their range, and
  the ranges' sizes make ranks of the numbers. Equal scores go to the smaller doc_id, then
  to any one of the rows; a null id comes first and its digits count as none.
* A null or empty text, and one without words, has no features and weight 0, and is never
  drawn. Repeated rows are repeated and each can be drawn. Where the corpus or the target is
  empty, all of its counts are 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import flat, sliced, written

WORDS, BUCKETS, SMOOTHING = 3, 10_000, 10_000
SEED, SHARE_PERCENT, LEAST_WORDS = 42, 5, 20
#: Text bytes whose suffixes are sorted at a time.
BLOCK_BYTES = 4 << 20

#: A byte of a word in lower case, or 0.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)


class Features:
    """Buckets of all runs of 1 to ``size`` words of the texts of one Arrow column.

    ``place`` holds for each occurrence the text that it is in, ``bucket`` the bucket of its run.
    """

    def __init__(self, column: pa.Array, size: int = WORDS, buckets: int = BUCKETS):
        data, ends = flat(column)
        own = np.append(_LOWER[data], np.uint8(0))
        inside = own != 0
        # words end with their text
        last = np.zeros(len(own), bool)
        last[ends[1:][np.diff(ends) > 0] - 1] = True
        opens = inside & np.concatenate([[True], ~inside[:-1] | last[:-1]])
        closes = inside & (np.concatenate([~inside[1:], [True]]) | last)
        starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        lens = stops - starts
        text = np.searchsorted(ends, starts, "right") - 1
        self.words = np.bincount(text, minlength=len(column))
        n = len(starts)
        # words side by side, each with one space after it: an n-gram's bytes lie together
        to = np.cumsum(lens + 1)
        joined = np.full(int(to[-1]) if n else 0, 32, np.uint8)
        joined[np.arange(int(lens.sum())) + np.repeat(np.arange(n), lens)] = own[inside]
        self.joined, self.begin, self.stop = joined.tobytes(), to - lens - 1, to - 1
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)), pa.py_buffer(own[inside])]) if n else pa.array([], pa.large_binary())
        ids = packed.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        order, shared = suffixes(ids, text, size)
        places, found = [], []
        for width in range(1, size + 1):
            place, bucket = self.runs(order, shared, width, text, buckets)
            places.append(text[place])
            found.append(bucket)
        self.place, self.bucket = np.concatenate(places), np.concatenate(found)

    def runs(self, order: np.ndarray, shared: np.ndarray, width: int, text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams of ``width`` words, in suffix order, and the bucket of each."""
        # a run goes on while the common prefix with the place before is this wide; n-grams lie within their text
        run = np.cumsum(shared < width)
        whole = order + width <= len(text)
        whole[whole] = text[order[whole]] == text[order[whole] + width - 1]
        place, run = order[whole], run[whole]
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        crc, joined = zlib.crc32, memoryview(self.joined)
        first = place[heads]
        hashes = np.fromiter((crc(joined[a:b]) % buckets for a, b in zip(self.begin[first].tolist(), self.stop[first + width - 1].tolist(), strict=True)), np.int64, len(heads))
        return place, np.repeat(hashes, np.diff(np.append(heads, len(place))))


def suffixes(ids: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``ids`` to ``depth`` words, and each place's common prefix with the one before it.

    A suffix ends with its text: what lies beyond counts as word 0, and words are numbered from 1.
    """
    n = len(ids)
    ahead = [ids]
    for k in range(1, min(depth, n)):
        following = np.zeros(n, np.int64)
        following[:-k] = np.where(text[k:] == text[:-k], ids[k:], 0)
        ahead.append(following)
    bits = int(ids.max()).bit_length() if n else 1
    order, k = np.arange(n), len(ahead)
    while k:  # from the last word to the first, as many words in one key as it holds
        take = min(k, 63 // bits)
        key = np.zeros(n, np.int64)
        for column in ahead[k - take : k]:
            key = (key << bits) | column
        order = order[np.argsort(key[order], kind="stable")]
        k -= take
    shared, same = np.zeros(n, np.int64), np.ones(n, bool)
    same[:1] = False
    for column in ahead:
        sorted_column = column[order]
        same[1:] &= (sorted_column[1:] == sorted_column[:-1]) & (sorted_column[1:] > 0)
        shared += same
    return order, shared


def bucket_counts(texts: DataFrame, size: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often the buckets occur in the column ``text``; buckets that don't are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in sliced(batches, 0, BLOCK_BYTES):
            counts += np.bincount(Features(b.column(0), size, buckets).bucket, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, size: int = WORDS, buckets: int = BUCKETS, smoothing: int = SMOOTHING) -> np.ndarray:
    """Each bucket's log ratio of its smoothed shares in the target and the corpus, in thousandths, rounded down."""
    counts = np.zeros((2, buckets), np.int64)
    both = bucket_counts(docs, size, buckets).select(F.lit(0).alias("side"), "*").union(bucket_counts(target, size, buckets).select(F.lit(1), "*"))
    for side, bucket, n in both.collect():  # two rows a bucket at most
        counts[side, bucket] = n
    (s, t), (all_s, all_t) = counts.astype(np.float64), counts.sum(axis=1).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (all_s + smoothing) / ((s + 1) * (all_t + smoothing)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, size: int = WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; weight is the sum of its features' gains."""
    names = ["doc_id", "n_words", "n_features", "weight"]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in sliced(batches, 1, BLOCK_BYTES):
            own = Features(b.column(1), size, len(gain))
            weight = np.bincount(own.place, gain[own.bucket], b.num_rows).astype(np.int64)  # sums of whole numbers
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (own.words, np.bincount(own.place, minlength=b.num_rows), weight))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """``weights`` with score: the weight and a Gumbel variate drawn by the id, in thousandths."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def ranked(scored: DataFrame, percent: int = SHARE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: the place among the drawn, from 1, or null.

    Rows are range-sorted once; no row meets all others in a task, and only the ranges' sizes
    come to the driver.
    """
    names = [*scored.columns, "part", "place"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(place, place + b.num_rows) + 1, pa.int64())], names)
            place += b.num_rows

    able = scored.where(F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()]
    kind = scored.select("*", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place")).schema
    sorted_rows = written(able.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(placed, kind), "draw-order")
    sizes = dict(sorted_rows.groupBy("part").count().collect())
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    drawn = percent * total // 100
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")] if before else F.lit(0)
    rank = offset.cast("long") + F.col("place")
    rest = scored.where(F.coalesce(F.col("n_words"), F.lit(0)) < least_words).select("*", F.lit(None).cast("long").alias("rank"))
    return sorted_rows.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank")).union(rest)


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every row of ``docs``; those drawn have a rank."""
    scored = written(noisy(weighed(docs, gains(docs, target))), "importance")
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
