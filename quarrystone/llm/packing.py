"""Sequence packing along a space-filling curve.

Hashed document vectors are projected to four dimensions, the projections are quantised and
read as one Hilbert key, Spark range-sorts the documents by that key, and each range is cut
into sequences in curve order, so that a sequence holds neighbouring documents.

* A null text counts as empty: its only id is the closing one.
* Ties on the curve are broken by doc_id, then by the row's number, so repeated rows stay side by
  side and a group of copies is spread over as many ranges as its size asks for, with ids or without.
* A document may be cut anywhere; each of its ids lies in exactly one piece.
* Every sequence is full but the last of a range. That one is cut into sequences whose
  lengths are powers of two, which need no padding.
* An empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import flat, sliced

SEQUENCE = 1024
DIMENSIONS, BITS = 4, 15
FEATURES = 1024
#: Text bytes that one task tokenizes at a time, and bytes of words whose ids a worker keeps, from task to task.
BLOCK_BYTES, KEPT_BYTES = 4 << 20, 4 << 20
#: Text bytes and documents whose hashed vectors are made at a time: few enough for a core's cache.
VECTOR_BYTES, VECTORS = 1 << 19, 1000


def hilbert_key(axes: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``axes`` (integers below 2**bits).

    Skilling, "Programming the Hilbert curve" (2004): undo the excess work from the highest
    bit down, Gray-encode, and interleave the transposed bits.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((FEATURES, DIMENSIONS)).astype(np.float32)


def curve_keys(column: pa.Array, project: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts: hashed byte trigrams, unit length, projected, squashed to a grid."""
    data, ends = flat(column)
    keys = np.empty(len(column), np.int64)
    at = 0
    while at < len(column):
        to = min(at + VECTORS, max(at + 1, int(np.searchsorted(ends, ends[at] + VECTOR_BYTES, "right")) - 1))
        own = data[ends[at] : ends[to]].astype(np.uint32)
        vectors = np.zeros((to - at, FEATURES), np.float32)
        if len(own) > 2:
            h = ((own[:-2] * np.uint32(0x9E3779B1)) ^ (own[1:-1] * np.uint32(0x85EBCA6B)) ^ (own[2:] * np.uint32(0xC2B2AE35))) >> np.uint32(22)
            row = np.repeat(np.arange(to - at, dtype=np.int64) * FEATURES, np.diff(ends[at : to + 1]))[: len(h)]
            vectors = np.bincount(row + h, minlength=vectors.size).astype(np.float32).reshape(vectors.shape)
        np.sqrt(vectors, out=vectors)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        grid = (np.tanh(vectors @ project) * 0.5 + 0.5) * ((1 << BITS) - 1)
        keys[at:to] = hilbert_key(grid.astype(np.int64), BITS)
        at = to
    return keys


class Ids:
    """Ids of texts by a ``tokenizers`` file, with the ids of words kept between texts.

    The pre-tokenizer of the byte-level vocabulary always cuts before a single space or line
    feed that stands between two visible characters. So words cut there can be encoded one
    by one; a text with any other white space is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words."""
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.starts, self.lens, self.odd = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.ids, self.used, self.n, self.kept = np.zeros(1 << 16, np.int32), 0, 0, 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def add(self, table: dict[str, int], words: list[str], head: bool) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            coded = self.encode([w if head or w[:1] == "\n" else f" {w}" for w in part])
            lens = np.fromiter(map(len, coded), np.int64, len(coded))
            while self.n + len(part) > len(self.lens):
                self.starts, self.lens, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.odd))
            while self.used + lens.sum() > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            new = slice(self.n, self.n + len(part))
            self.lens[new] = lens
            self.starts[new] = self.used + np.cumsum(lens) - lens
            self.odd[new] = [not w or w[-1].isspace() or (w[1:2] if w[0] == "\n" and not head else w[0]).isspace() for w in part]
            self.ids[self.used : self.used + lens.sum()] = np.fromiter((i for c in coded for i in c), np.int32, int(lens.sum()))
            table.update(zip(part, range(self.n, self.n + len(part)), strict=True))
            self.n += len(part)
            self.used += int(lens.sum())
            self.kept += sum(map(len, part))

    def rows(self, table: dict[str, int], words: list[str], head: bool) -> np.ndarray:
        if new := [w for w in words if w not in table]:
            self.add(table, new, head)
        return np.fromiter((table[w] for w in words), np.int64, len(words))

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none)."""
        if self.kept > KEPT_BYTES:
            self.clear()
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " \n"), " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        rows = self.rows(self.words, coded.dictionary.to_pylist(), False)[coded.indices.to_numpy()]
        firsts = cut.values.take(pa.array(cut.offsets.to_numpy()[:-1])).dictionary_encode()
        rows[ends[:-1]] = self.rows(self.heads, firsts.dictionary.to_pylist(), True)[firsts.indices.to_numpy()]
        lens = self.lens[rows]
        to = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(self.starts[rows] - to[:-1], lens) + np.arange(to[-1])]
        odd = np.add.reduceat(self.odd[rows].astype(np.int64), ends[:-1]) > 0 if len(rows) else []
        for i in range(len(texts)):
            if odd[i]:
                yield np.asarray(self.encode([texts[i].as_py() or ""])[0], np.int32)
            else:
                yield ids[to[ends[i]] : to[ends[i + 1]]]


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One table of ids for each Python worker."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


class Sequences:
    """Pieces of one range, in curve order; ``rows`` collects those of sequences that are complete."""

    def __init__(self, first: int, size: int):
        self.size, self.sequence, self.filled = size, first, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.size - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], n))
            self.filled += take
            at += take
            if self.filled == self.size:
                self.close(self.open)

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def end(self) -> None:
        """The last ids, in sequences whose lengths are the powers of two that they add up to."""
        rest, left = self.open, self.filled
        while left:
            want, own = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                doc_id, start, ids, n = rest.pop(0)
                own.append((doc_id, start, ids[:want], n))
                if len(ids) > want:
                    rest.insert(0, (doc_id, start + want, ids[want:], n))
                want -= len(own[-1][2])
            self.close(own)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The documents are range-sorted once, with their texts; the ids are made after that sort,
    so they are never shuffled. A sequence_id is the number of the range, times 2**40, plus
    the sequence's place in it.
    """
    project = projection()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve_keys(b.column(1), project))], ["doc_id", "text", "row", "curve"])

    names = [x.split()[0] for x in PIECE.split(",")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        made = Sequences(TaskContext.get().partitionId() << 40, size)

        def out() -> pa.RecordBatch:
            rows, made.rows = made.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)

        for b in sliced(batches, 1, BLOCK_BYTES):
            for doc_id, own in zip(b.column(0).to_pylist(), ids.of(b.column(1)), strict=True):
                made.put(doc_id, np.append(own, np.int32(end_id)))
            yield out()
        made.end()
        yield out()

    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
        .mapInArrow(keyed, "doc_id long, text string, row long, curve long")
        .repartitionByRange("curve", "doc_id", "row")
        .sortWithinPartitions("curve", "doc_id", "row")
        .select("doc_id", "text")
        .mapInArrow(packed, PIECE)
    )
