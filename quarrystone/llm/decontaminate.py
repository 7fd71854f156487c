"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``WINDOW`` consecutive words of a benchmark item (a shorter item is one
window) is a set of word shingles. The shingles are ordered by rarity: the number of
documents, of all, that hold them. A document can contain a window only if it contains every
shingle of it, so the necessary prefix of that order is one shingle, the rarest. Documents
are joined with the windows on it; the shingle's place in the window and the lengths bound
where the window may stand; what is left is verified word by word.

The windows of a block, at most ``BLOCK`` different ones, go to all tasks without their items,
and documents never move. A larger benchmark is taken in several blocks, each a pass over all
documents that adds to what the passes before have found; so no size of benchmark is out of
reach of a task. Which items hold a window is joined afterwards, once for each different set
of windows that documents hold; so a window that very many items share goes to no task whole.

* Null texts, in either table, have no words and so no windows and no hits. A document with
  no words isn't contaminated.
* A window counts for every item that holds it; repeated items count once; an item without
  an id makes hits but isn't counted or named. Repeated documents are repeated.
* Empty tables give no rows, or rows without hits. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import sliced, texts_of, written

WINDOW = 13
SHINGLE = 2
BLOCK = 200_000
#: A document is contaminated if this share of its words, at least, is hit: 1 in 20.
SHARE = 20

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII digits and letters, lower-cased, and of everything beyond ASCII."""
    return text.translate(_WORDS).split()


def shingled(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(size)), strict=False))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): one row for each window of each item."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                own = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string())], ["item", "words"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(of, "item string, words string").distinct()


def document_frequencies(docs: DataFrame, wanted: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """In how many documents each of ``wanted`` shingles occurs; each task adds up its own first."""
    sizes = sorted({len(s) for s in wanted})
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = shared.value, Counter()
        for b in sliced(batches, 0):
            for text in texts_of(b.column(0)):
                words = words_of(text)
                for size in sizes:
                    counts.update(vocabulary.intersection(shingled(words, size)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in counts], pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["shingle", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(of, "shingle string, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {tuple(r["shingle"].encode().split(b" ")): r["n"] for r in found}


class Index:
    """Windows by their rarest shingle, then by the shingle's place in the window and the window's length."""

    def __init__(self, rows: list[tuple[int, bytes]], frequency: dict[tuple[bytes, ...], int], size: int = SHINGLE):
        self.by: dict[int, dict] = {}
        for number, text in rows:
            words = tuple(text.split(b" "))
            shingles = shingled(list(words), min(size, len(words)))
            rarest = min(shingles, key=lambda s: (frequency.get(s, 0), s))
            places = self.by.setdefault(len(rarest), {}).setdefault(rarest, {})
            places.setdefault((shingles.index(rarest), len(words)), {})[words] = number

    def search(self, words: list[bytes], spans: list[tuple[int, int]], found: set[int]) -> None:
        """Adds the places of windows in ``words``, as (start, end), and the windows' numbers."""
        n = len(words)
        for size, index in self.by.items():
            shingles = shingled(words, size)
            if index.keys().isdisjoint(shingles):
                continue
            for at, shingle in enumerate(shingles):
                if shingle in index:
                    for (offset, length), exact in index[shingle].items():
                        start = at - offset
                        if start >= 0 and start + length <= n and (number := exact.get(tuple(words[start : start + length]))) is not None:
                            spans.append((start, start + length))
                            found.add(number)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Union of spans, as start, end, start, end ... in order."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``docs`` with n_words, spans (hit words, as start, end, start, end ...) and windows (numbers of those found), and (window, item) of the benchmark."""
    spark = docs.sparkSession
    names = [*docs.columns, "n_words", "spans", "windows"]
    at = names.index("text")
    parts = written(windows(benchmark, window), "windows")
    forms = written(parts.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "window-forms")
    blocks = max(1, -(-forms.count() // block))
    state = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<long>").alias("windows"))
    for k in range(blocks):
        rows = [(r["window"], r["words"].encode()) for r in forms.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()]
        wanted = {s for _, w in rows for s in shingled(w.split(b" "), min(shingle, w.count(b" ") + 1))}
        shared = spark.sparkContext.broadcast(Index(rows, document_frequencies(docs, wanted) if wanted else {}, shingle))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in sliced(batches, at):
                n_words, all_spans, all_found = [], [], []
                for text, before, had in zip(texts_of(b.column(at)), b.column(len(names) - 2).to_pylist(), b.column(len(names) - 1).to_pylist(), strict=True):
                    words, found = words_of(text), set(had)
                    spans = list(zip(before[::2], before[1::2], strict=True))
                    index.search(words, spans, found)
                    n_words.append(len(words))
                    all_spans.append(merged(spans))
                    all_found.append(sorted(found))
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n_words, pa.int64()), pa.array(all_spans, pa.list_(pa.int32())), pa.array(all_found, pa.list_(pa.int64()))], names)

        state = state.mapInArrow(search, state.schema)
        if k + 1 < blocks:
            state = written(state, "contamination")
    return state, parts.where("item IS NOT NULL").join(forms, "words").select("window", "item")


def judged(found: DataFrame) -> DataFrame:
    """``found`` with n_hit and contaminated in place of spans."""
    n_hit = F.expr("aggregate(sequence(0, size(spans) - 2, 2), 0L, (n, i) -> n + spans[i + 1] - spans[i])")
    hit = found.withColumn("n_hit", F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0)).cast("long")).drop("spans")
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def with_items(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """``found`` (doc_id, windows, ...), written, with items (ids as text, sorted) in place of windows.

    Each different set of windows is looked up once. Documents without windows, most of all, are
    dealt out by their id.
    """
    sets = found.where(F.size("windows") > 0).select("windows").distinct()
    each = sets.select("windows", F.explode("windows").alias("window")).join(pairs, "window")
    named = each.groupBy("windows").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnRenamed("windows", "asked")
    key = F.when(F.size("windows") > 0, F.col("windows")).otherwise(F.array(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))))
    joined = found.join(named, key == F.col("asked"), "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).drop("windows", "asked")


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and contaminated (see the module)."""
    found, pairs = occurrences(docs, benchmark, **how)
    return with_items(written(judged(found), "contamination"), pairs).withColumn("n_items", F.size("items").cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated."""
    names = docs.columns
    own = docs.select(*[F.col(c).alias(f"doc_{i}") if c != "text" else F.col(c) for i, c in enumerate(names)])
    found, _ = occurrences(own, benchmark)
    return judged(found).where(~F.col("contaminated")).select(*[F.col(f"doc_{i}" if c != "text" else c).alias(c) for i, c in enumerate(names)])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found, pairs = occurrences(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    told = with_items(written(judged(found).drop("text"), "contamination"), pairs)
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, upper_lower),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, upper_lower),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM items WHERE len(ws) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM sized)),
places AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
           FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(ws) >= n)),
found AS (SELECT doc_id, n, p, item_id FROM places JOIN wins USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT doc_id, p, n FROM found)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
