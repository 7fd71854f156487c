"""Substring duplicates by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: each byte's table value is added to the hash
shifted left, so a hash of 16 bits, shifted by two, depends on the last ``WINDOW`` bytes alone.
It is read where words end: of every ``AHEAD`` word ends in a row, the last of those with the
least hash is picked. A chunk lies between two picked places, and its digest covers the gear
window before it too. So an insertion changes the chunks beside it only, no chunk has more than
``AHEAD`` words, and any ``WORDS`` words that two texts share hold a chunk that both have: the
first four words, of one byte each, may lie in a gear window that begins before them, and
4 + 2 x ``AHEAD`` is below ``WORDS``.

A chunk that two different texts hold is a seed. A run of ``WORDS`` words can repeat only if all
chunks that it fixes, whatever stands around it, are seeds. Such runs are compared whole, by
digest, with the runs that have the same rarest seed: runs that share a seed travel as one row,
sorted by it. Seeds that more than ``BOUNDED`` chunks have are taken another way: equal rows
become one by partial aggregation, the runs of different rows are compared, and a join that
Spark splits when skewed hands on what is found. Overlapping repeats that have one first
holder, the document of smallest id that holds them, make a span; where the holder changes, spans overlap.

* Every passage of ``WORDS`` words or more that two documents hold is reported, from its first
  whole word to its last. Words lie between ASCII white space; each character of U+3000 to
  U+9FFF is a word, as there is no space between those. White space within counts as it stands.
* Equal texts are compared with others once; each of their documents gets all spans, and one
  over the whole text if it has ``WORDS`` words.
* A null or empty text has no chunks. Offsets are code points, ends exclusive. Documents
  without repeats give no rows; repeats within one document are none. A null doc_id is a
  document of its own that is never named first: what only such documents hold is kept by all.
  An id on two texts is two documents. Rows that repeat id and text count as one document.
* An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import sliced, texts_of, unused, written

#: Bytes that a hash depends on; word ends of which one is picked.
WINDOW, AHEAD = 8, 23
#: Words of the shortest reported span: over 50.
WORDS = 51
#: Chunks of one seed up to which the runs around them meet in one task.
BOUNDED = 500
#: Rows that a task gathers before it hands them on.
FLUSHED = 100_000

GEAR = np.random.default_rng(1913).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, in bytes."""
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    alone = np.concatenate([(data >= 0xE3) & (data <= 0xE9), np.zeros(4, bool)])[: len(data) + 1]
    breaks = alone.copy()
    breaks[3:] |= alone[:-3]
    starts = word[1:] & (~word[:-1] | breaks)
    ends = word[:-1] & (~word[1:] | breaks)
    return np.flatnonzero(starts), np.flatnonzero(ends)


def picked(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words whose end is picked, and the first and last of the rows of ``AHEAD`` ends that pick each."""
    n = len(ends)
    if n < AHEAD:
        return (np.zeros(0, np.int64),) * 3
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # the sum over twice as many bytes, from two sums over half of them
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(2 * step)
        h, step = more, step * 2
    # of equal hashes the later one is less
    least = (h[ends - 1].astype(np.uint64) << np.uint64(40)) | np.arange(n, 0, -1, dtype=np.uint64)
    step = 1
    while step < AHEAD:  # the least of up to twice as many, from two that may overlap
        by = min(step, AHEAD - step)
        least, step = np.minimum(least[:-by], least[by:]), step + by
    at, first = np.unique(n - (least & np.uint64((1 << 40) - 1)).astype(np.int64), return_index=True)
    return at, first, np.append(first[1:], len(least)) - 1


def seeds_of(text: bytes, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A digest for each chunk between picked words ``at``."""
    places = ends[at].tolist()
    return np.array([xxhash.xxh3_64_intdigest(text[max(0, i - WINDOW) : j]) for i, j in zip(places[:-1], places[1:], strict=True)], np.uint64).view(np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """(row, number, seed): one row per chunk of every text of ``docs`` (row, text) that has ``WORDS`` words."""
    names = ["row", "number", "seed"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seeds, waiting = [], [], 0

        def flush() -> pa.RecordBatch:
            number = np.concatenate([np.arange(len(own), dtype=np.int32) for own in seeds])
            out = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), [len(own) for own in seeds])), pa.array(number), pa.array(np.concatenate(seeds))], names)
            rows.clear()
            seeds.clear()
            return out

        for b in sliced(batches, 1):
            for row, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                data = np.frombuffer(text, np.uint8)
                ends = words_of(data)[1]
                if len(ends) >= WORDS:
                    rows.append(row)
                    seeds.append(seeds_of(text, ends, picked(data, ends)[0]))
                    waiting += len(seeds[-1])
                if waiting > FLUSHED:
                    yield flush()
                    waiting = 0
        if rows:
            yield flush()

    return docs.select("row", "text").mapInArrow(of, "row long, number int, seed long")


def runs_of(text: bytes, marks: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Start and stop (bytes), digest, rarest seed and its count of each run of ``WORDS`` words that can repeat; ``marks``: the text's seeds as (chunk, count)."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = words_of(data)
    at, low, high = picked(data, ends)
    count = np.zeros(len(at) - 1, np.int64)
    for number, n in marks:
        count[number] = n
    seeds, others = seeds_of(text, ends, at), np.concatenate([[0], np.cumsum(count == 0)])
    run = np.arange(len(starts) - WORDS + 1)
    # the picked places that the run fixes: some row of AHEAD ends within the run picks them
    first = np.searchsorted(high, np.searchsorted(ends, starts[run] + WINDOW))
    last = np.searchsorted(low, run + WORDS - AHEAD, "right") - 1
    run = run[others[last] == others[first]]
    first, last = first[run], last[run]
    best = first
    for k in range(1, int((last - first).max(initial=0))):
        other = np.minimum(first + k, last - 1)
        best = np.where((count[other] < count[best]) | (count[other] == count[best]) & (seeds[other] < seeds[best]), other, best)
    starts, ends = starts[run], ends[run + WORDS - 1]
    digests = np.array([xxhash.xxh3_64_intdigest(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
    return starts, ends, digests, seeds[best], count[best]


RUNS = "row long, least long, seed long, n long, words int, starts array<int>, stops array<int>, digests array<long>"


def compared(docs: DataFrame) -> DataFrame:
    """The runs of each text of ``docs`` (row, least, copies, text, marks) that can repeat, those side by side with one seed in a row.

    A text of several documents gives a row of its own, without a seed, for its whole length.
    """
    names = [x.split()[0] for x in RUNS.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> pa.RecordBatch:
            lists = []
            for k in (5, 6, 7):
                values = np.concatenate([r[k] for r in found])
                lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in found)]), pa.int32()), pa.array(values, pa.int32() if k < 7 else pa.int64())))
            out = pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in found], pa.int64()) for k in range(4)), pa.array([r[4] for r in found], pa.int32()), *lists], names)
            found.clear()
            return out

        waiting = 0
        for b in sliced(batches, 3):
            for row, least, copies, text, marks in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), texts_of(b.column(3)), b.column(4).to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                starts, ends = words_of(data)
                if len(starts) < WORDS:
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).astype(np.int32)
                if copies > 1:
                    found.append((row, least, None, None, len(starts) - WORDS + 1, chars[starts[:1]], chars[ends[-1:]], np.zeros(1, np.int64)))
                if marks:
                    starts, ends, digests, seeds, count = runs_of(text, [(m["number"], m["n"]) for m in marks])
                    cut = np.flatnonzero((seeds[1:] != seeds[:-1]) | (starts[1:] >= ends[:-1])) + 1
                    for i, j in zip([0, *cut], [*cut, len(starts)], strict=True) if len(starts) else ():
                        found.append((row, least, int(seeds[i]), int(count[i]), j - i, chars[starts[i:j]], chars[ends[i:j]], digests[i:j]))
                    waiting += len(starts)
            if waiting > FLUSHED:
                yield flush()
                waiting = 0
        if found:
            yield flush()

    return docs.select("row", "least", "copies", "text", "marks").mapInArrow(of, RUNS)


HELD = "row long, least long, start int, stop int, words int, first_least long, first_row long"


def resolved(runs: DataFrame) -> DataFrame:
    """The repeated stretches of ``runs``, whose seeds have few chunks: those of one seed meet in one task, a few at a time."""
    names = [x.split()[0] for x in HELD.split(", ")]

    def some(part: pa.Table) -> pa.RecordBatch:
        row, seed = (part.column(k).to_numpy() for k in ("row", "seed"))
        ids = part.column("least").combine_chunks()
        # the order of texts: named ones by their smallest id, then the others
        by = np.lexsort((row, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
        rank = np.empty(len(row), np.int64)
        rank[by] = np.cumsum(np.concatenate([[0], row[by][1:] != row[by][:-1]]))
        lists = {k: part.column(k).combine_chunks() for k in ("starts", "stops", "digests")}
        sizes = np.diff(lists["digests"].offsets.to_numpy())
        starts, stops, digests = (lists[k].flatten().to_numpy() for k in ("starts", "stops", "digests"))
        of = np.repeat(np.arange(len(row)), sizes)
        order = np.lexsort((rank[of], digests, seed[of]))
        new = np.concatenate([[True], (digests[order][1:] != digests[order][:-1]) | (seed[of][order][1:] != seed[of][order][:-1])])
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first, last = order[begin], order[np.append(begin[1:], len(order)) - 1]
        holder = np.empty(len(order), np.int64)
        holder[order] = np.where(rank[of[first]] != rank[of[last]], of[first], -1)[group]
        # stretches of one row whose runs have one first holder
        edge = np.flatnonzero(np.concatenate([[True], (holder[1:] != holder[:-1]) | (of[1:] != of[:-1])]))
        upto = np.append(edge[1:], len(holder)) - 1
        edge, upto = edge[holder[edge] >= 0], upto[holder[edge] >= 0]
        return pa.RecordBatch.from_arrays([pa.array(row[of[edge]]), ids.take(pa.array(of[edge])), pa.array(starts[edge]), pa.array(stops[upto]), pa.array((upto - edge + 1).astype(np.int32)), ids.take(pa.array(holder[edge])), pa.array(row[holder[edge]])], names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if b.num_rows == 0:
                continue
            part = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            seed = part.column("seed").to_numpy()
            cut = int(np.searchsorted(seed, seed[-1]))
            if cut:
                yield some(part.slice(0, cut))
            rest = part.slice(cut)
        if rest is not None:
            yield some(rest)

    return runs.select("row", "least", "seed", "starts", "stops", "digests").repartition("seed").sortWithinPartitions("seed").mapInArrow(of, HELD)


def resolved_at_large(runs: DataFrame) -> DataFrame:
    """The repeated stretches of ``runs``, however many share a seed: equal rows are taken as one, with partial aggregation.

    What very many texts hold makes few different rows. Their runs are compared one by one; what is found is handed
    to the texts by a join that Spark splits when skewed.
    """
    holder = F.struct(F.col("least").isNull().alias("unnamed"), "least", "row")
    runs = runs.withColumn("key", F.xxhash64("seed", "digests"))
    kinds = written(runs.groupBy("seed", "key").agg(F.min(holder).alias("a"), F.max(holder).alias("b"), F.min("digests").alias("digests")), "run-kinds")
    each = kinds.select("seed", "key", "a", "b", F.posexplode("digests").alias("at", "digest"))
    shared = written(each.groupBy("seed", "digest").agg(F.min("a").alias("first"), F.max("b").alias("last")).where("first.row <> last.row").select("seed", "digest", "first"), "shared-runs")
    found = each.hint("merge").join(shared, ["seed", "digest"]).select("seed", "key", "at", "first")
    # runs side by side with one first holder have one difference of place and rank
    rank = F.row_number().over(Window.partitionBy("seed", "key", "first").orderBy("at"))
    stretches = found.withColumn("island", F.col("at") - rank).groupBy("seed", "key", "first", "island").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    stretches = written(stretches.select("seed", "key", "first", "low", "high"), "stretches")
    held = runs.select("seed", "key", "row", "least", "starts", "stops").hint("merge").join(stretches, ["seed", "key"])
    return held.select("row", "least", F.expr("starts[low]").alias("start"), F.expr("stops[high]").alias("stop"), F.expr("high - low + 1").alias("words"), F.col("first.least").alias("first_least"), F.col("first.row").alias("first_row"))


def repeats(docs: DataFrame, bounded: int = BOUNDED) -> DataFrame:
    """(doc_id, start, stop, n_chars, n_chunks, first_doc, kept, text_hash): the repeated spans of every document.

    ``n_chunks`` counts the span's repeated runs of ``WORDS`` words. ``kept`` is true where the
    document itself is the first to hold them. What repeats is found by partial
    aggregation, so a chunk that very many documents hold costs each task one row; the joins
    that hand this on are ones that Spark splits when skewed.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    every = chunked(own)
    seeds = written(every.groupBy("seed").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.count("*").alias("n")).where("a <> b").select("seed", "n"), "seeds")
    # the lists of what repeats grow with the documents: they are shuffled at every size, and written first, so that a skewed side can be split
    marks = every.hint("merge").join(seeds, "seed").groupBy("row").agg(F.collect_set(F.struct("number", "n")).alias("marks"))
    ids = written(own.groupBy("row", "doc_id").agg(F.count("*").alias("n")), "texts")
    texts = ids.groupBy("row").agg(F.min("doc_id").alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1)).alias("copies"))
    asked = texts.join(marks, "row", "left").where("copies > 1 or marks is not null").withColumnRenamed("row", "asked_row")
    # rows of one text become one before they are shuffled
    distinct = own.groupBy("row").agg(F.min("text").alias("text"))
    runs = written(compared(distinct.hint("merge").join(asked, F.col("row") == F.col("asked_row"))), "runs")
    whole = runs.where("seed is null").select("row", "least", F.col("starts")[0].alias("start"), F.col("stops")[0].alias("stop"), "words", F.col("least").alias("first_least"), F.col("row").alias("first_row"))
    held = resolved(runs.where(F.col("n") <= bounded)).union(resolved_at_large(runs.where(F.col("n") > bounded))).union(whole)
    by_row = Window.partitionBy("row", "first_least", "first_row").orderBy("start", "stop")
    before = F.max("stop").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    spans = held.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("span", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct(F.col("first_least").isNull().alias("unnamed"), "first_least", "first_row")
    found = written(spans.groupBy("row", "first_least", "first_row", "span").agg(F.min("least").alias("least"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_chunks"), F.min(first).alias("first")).drop("first_least", "first_row", "span"), "spans")
    # a text of one document has that as its least; those of very many are dealt by id
    alone = found.join(texts.where("copies > 1").select("row"), "row", "left_anti").withColumn("doc_id", F.col("least"))
    many = ids.join(texts.where("copies > 1").select("row"), "row", "left_semi").select("row", F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1).alias("rows"), "doc_id").hint("merge").join(found, "row")
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    columns = ["doc_id", "row", "least", "start", "stop", "n_chunks", "first"]
    kept = F.col("first.unnamed") | (F.col("first.first_row") == F.col("row")) & F.col("doc_id").eqNullSafe(F.col("least"))
    return (
        alone.select(columns)
        .union(many.select(columns))
        .select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_chars"), "n_chunks", F.col("first.first_least").alias("first_doc"), kept.alias("kept"), F.col("row").alias("text_hash"))
    )


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans that an earlier document holds cut out of their texts."""
    cuts, cut_id, cut_hash = unused(docs, "cuts", "cut_id", "cut_hash")
    cut = spans.where("not kept").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias(cuts)).withColumnsRenamed({"doc_id": cut_id, "text_hash": cut_hash})
    text = F.col("text")
    # from cut to cut: how far the text is done, and what of it stays
    passed = F.aggregate(
        cuts,
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("kept")),
        lambda done, c: F.struct(F.greatest(done["upto"], c["stop"].cast("int")).alias("upto"), F.array_append(done["kept"], text.substr(done["upto"] + 1, F.greatest(c["start"].cast("int") - done["upto"], F.lit(0)))).alias("kept")),
        lambda done: F.array_join(F.array_append(done["kept"], text.substr(done["upto"] + 1, F.length(text))), ""),
    )
    joined = docs.join(cut, F.col("doc_id").eqNullSafe(F.col(cut_id)) & (F.xxhash64("text") == F.col(cut_hash)), "left")
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), text).otherwise(passed)).select(*docs.columns)
