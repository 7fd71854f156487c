"""Fill-in-the-middle transformation over overlapping chunks.

A text's units (code points, words or lines) begin where a predicate of two adjacent bytes
holds, so a chunk that overlaps its left neighbour by one byte counts its own boundaries
without any other chunk. The boundaries of all chunks of a block of texts are counted at
once; prefix sums over the chunks of a text give each chunk its first rank; both cut ranks
go to the chunks that own them, and only those are scanned again, for the byte of the cut.

* Ids and cuts: four numbers are read from the sha256 of ``seed:doc_id``; a null id counts as
  no digits. So repeated rows are cut alike.
* A null or empty text, and one that holds a marker, is plain: it is handed on as it is (null:
  empty) and its cut columns are null. So are the documents that the rate leaves out.
* A very long text is scanned chunk by chunk, and never cut short. An empty table gives no
  rows; further columns pass through, but for those of the names that are added, which are
  overwritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import flat, replaced, sliced

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SUFFIX_FIRST_PERCENT = 1, 90, 20
CHUNK = 16 << 10
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Whether a unit begins at the second of two adjacent bytes; before the first byte of a text stands a line feed.
BEGINS = {
    "chars": lambda before, own: (own & 0xC0) != 0x80,
    "words": lambda before, own: _SPACE[before] & ~_SPACE[own],
    "lines": lambda before, own: before == 10,
}


class Chunks:
    """Chunks of at most ``size`` bytes of the texts in ``data``, whose n + 1 offsets are ``ends``, and their unit counts."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str = "chars", size: int = CHUNK):
        self.data, self.ends, self.begins = data, ends, BEGINS[unit]
        per = -(-np.diff(ends) // size)
        self.first = np.concatenate([[0], np.cumsum(per)])
        text = np.repeat(np.arange(len(per)), per)
        self.start = ends[:-1][text] + size * (np.arange(len(text)) - self.first[:-1][text])
        self.stop = np.minimum(self.start + size, ends[1:][text])
        self.opens = self.start == ends[:-1][text]
        counts = np.fromiter((np.count_nonzero(self.marks(k)) for k in range(len(text))), np.int64, len(text))
        self.before = np.concatenate([[0], np.cumsum(counts)])
        #: Units of each text.
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def marks(self, chunk: int) -> np.ndarray:
        """Where units begin in a chunk; the byte before it is its overlap."""
        a, b = self.start[chunk], self.stop[chunk]
        own = self.data[a:b]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[0] = 10 if self.opens[chunk] else self.data[a - 1]
        return self.begins(before, own)

    def places(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The byte within its text at which the unit of each rank begins; the text's end for the rank after the last."""
        out = np.diff(self.ends)[texts]
        for k in np.flatnonzero(ranks < self.units[texts]):
            text, rank = texts[k], self.before[self.first[texts[k]]] + ranks[k]
            chunk = int(np.searchsorted(self.before, rank, "right")) - 1
            at = np.flatnonzero(self.marks(chunk))[rank - self.before[chunk]]
            out[k] = self.start[chunk] + at - self.ends[text]
        return out


def drawn(seed: int, doc_id: Column) -> Column:
    """The first four groups of eight hex digits of the sha256 of ``seed:doc_id``, as an array of numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def transform(docs: DataFrame, unit: str = "chars", seed: int = SEED, percent: int = PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (units; null if plain) and output.

    psm is prefix, suffix, middle behind their markers; spm has suffix and prefix the other way round.
    """
    docs = replaced(docs, ADDED)
    given = len(docs.columns) - len(ADDED)
    at, names = docs.columns.index("text"), docs.columns
    numbers = "drawn".ljust(1 + max(map(len, names)), "_")  # longer than any name, so it is none of them
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            data, ends = flat(b.column(at))
            h = b.column(len(names)).flatten().to_numpy().reshape(-1, 4)
            chunks = Chunks(data, ends, unit, chunk)
            n, size = chunks.units, np.diff(ends)
            view = data.tobytes()
            marked = np.array([any(view.find(m, i, j) >= 0 for m in marks) for i, j in zip(ends[:-1], ends[1:], strict=True)], bool)
            plain = (size == 0) | marked | (h[:, 2] % 100 >= percent)
            cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
            cut = np.flatnonzero(~plain)
            spm = h[:, 3] % 100 < suffix_first
            places = np.stack([chunks.places(cut, cuts[cut, k]) for k in (0, 1)], axis=1) if len(cut) else np.zeros((0, 2), np.int64)
            outputs = [view[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            for i, (a, z) in zip(cut, places.tolist(), strict=True):
                own = outputs[i]
                begin, end = [marks[0], own[:a]], [marks[1], own[z:]]
                outputs[i] = b"".join([*(end + begin if spm[i] else begin + end), marks[2], own[a:z]])
            forms = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            columns = [pa.array(n), pa.array(forms.tolist(), pa.string()), pa.array(cuts[:, 0], mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:given], *columns], names)

    return docs.withColumn(numbers, drawn(seed, F.col("doc_id"))).mapInArrow(of, docs.schema)


def restored(form: Column, output: Column) -> Column:
    """The text of an ``output`` of its ``form``: the parts between the markers, in their order in the text."""
    size = len(PREFIX)
    rest, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def parts(second: str) -> tuple[Column, Column]:
        at = F.instr(rest, second)
        return rest.substr(F.lit(size + 1), at - F.lit(size + 1)), rest.substr(at + size, F.length(rest))

    begin, end = parts(SUFFIX)
    psm = F.concat(begin, middle, end)
    end, begin = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(begin, middle, end)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row."""
    own = transform(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    back = restored(F.col("form"), F.col("output"))
    return own.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
numbers AS (SELECT doc_id, text, length(text) AS n, [CAST('0x' || substr(hex, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS h FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, z - a) AS m, substr(text, z + 1, n - z) AS s FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
