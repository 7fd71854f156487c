"""SentencePiece encoding and decoding by backtracking over merge-type vocabularies.

Merging takes, time after time, the adjacent pair whose union is the best-scored piece, the
leftmost of equals. What it leaves is the one sequence of pieces in which every two
neighbours, merged on their own, stay as they are. So a text is encoded without a queue of
merges: an Aho-Corasick pass finds the longest piece at every place; pieces are laid one
after another, each held against its left neighbour by merging the two anew (answers are
kept); where none fits, the last piece is taken back for its next shorter prefix, and a
bitfield keeps the places from which no sequence goes on, so none is tried twice.

* Characters that no piece holds are cut out first and become byte pieces. Where the
  vocabulary allows it (no piece goes on with a space after another character) texts are cut
  before spaces too, and each distinct stretch of a task is encoded once.
* A null text counts as empty: its ids are the begin and end ids alone, and decode to the
  empty text. Very long texts are encoded whole, stretch by stretch.
* Rows are never dropped, repeated rows are repeated, an empty table gives none; further
  columns pass through, but for those of the names that are added, which are overwritten.
* Vocabularies of another type than merges, with normalisation rules, with user-defined
  pieces or without byte pieces raise ValueError.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import replaced, sliced, texts_of

SPACE = "▁"
#: Kinds of pieces, and the type of a merge vocabulary, in the model's file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2
#: Characters of the longest stretch whose ids are kept, and of those that are kept before the ones not met since are forgotten.
STRETCH, KEPT = 64, 3 << 20
#: Neighbours whose compatibility is kept, and text bytes encoded at a time.
PAIRS, BLOCK_BYTES = 300_000, 3 << 20
#: Characters of a text from which its stretches are cut out one by one.
LONG = 1 << 20


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields: numbers as they stand, all else as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, message[at : at + size]
            at += size


class Vocabulary:
    """Pieces, scores and kinds by id, as a model file holds them."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != MERGES or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("only merge vocabularies with byte pieces and without normalisation are encoded")
        if USER_DEFINED in self.kinds or self.kinds.count(BYTE) != 256:
            raise ValueError("user-defined pieces aren't known here, and all 256 byte pieces are needed")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.begin, self.end = (trainer.get(n, d) for n, d in ((41, 1), (42, 2)))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode())


class Kept(dict):
    """Packed ids by stretch. When many are kept, those that were not met since the last time go."""

    def __init__(self, of: Callable[[str], bytes]):
        self.of, self.older, self.size = of, {}, 0

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.of(text)
        if len(text) <= STRETCH:
            if self.size > KEPT:
                self.older, self.size = dict(self), 0
                self.clear()
            self[text] = found
            self.size += len(text)
        return found


class Codec:
    """Encodes and decodes texts by one model file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as file:
            self.vocabulary = own = Vocabulary(file.read())
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(own.pieces, own.kinds, strict=True)) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(own.pieces, own.kinds, strict=True)) if k == NORMAL}
        self.known = {c for p in self.ids for c in p}
        # a piece that merging its own characters doesn't give is never in a result
        self.reached = {p: i for p, i in self.ids.items() if len(self.merged(p)) == 1}
        self.shorter = {i: next((self.reached[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), None) for p, i in self.reached.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece, i in self.reached.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        odd = any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        line = "" if "\n" in self.known else "\n"
        self.stretches = re.compile("(?s).+" if odd else f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+|\n+")
        self.surfaces = [self.surface(i) for i in range(len(own.pieces))]
        self.lengths = [len(p) for p in own.pieces]
        self.fits: dict[int, bool] = {}
        self.kept = Kept(self.stretch)

    def merged(self, text: str) -> list[str]:
        """The parts that remain of ``text``, best score first, leftmost first; for the short texts of one or two pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.vocabulary.scores[i] > best):
                    best, at = self.vocabulary.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two pieces side by side, taken apart and merged anew, are those two again."""
        a, b = self.vocabulary.pieces[left], self.vocabulary.pieces[right]
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        found = self.fits[left << 32 | right] = self.merged(a + b) == [a, b]
        return found

    def backtracked(self, text: str) -> list[int]:
        """Ids of a stretch whose characters are all known."""
        n, lengths, shorter, fits = len(text), self.lengths, self.shorter, self.fits.get
        longest: list[int | None] = [None] * (n + 1)
        for end, i in self.automaton.iter(text):
            longest[end + 1 - lengths[i]] = i  # ends come in order, so the last one is the longest
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, i, last = 0, longest[0], None
        while at < n:
            while i is not None:
                to = at + lengths[i]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if last is None:
                        break
                    fit = fits(last << 32 | i)
                    if fit or fit is None and self.compatible(last, i):
                        break
                i = shorter[i]
            if i is not None:
                out.append(i)
                at, last = to, i
                i = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                at -= lengths[i]
                i, last = shorter[i], out[-1] if out else None
        return out

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch, packed; characters that no piece holds are byte pieces."""
        if self.known.issuperset(text):
            return struct.pack(f"<{len(own)}I", *own) if len(own := self.backtracked(text)) < 64 else np.asarray(own, "<u4").tobytes()
        out: list[int] = []
        begin = 0
        for at, c in enumerate(text):
            if c not in self.known:
                if at > begin:
                    out += self.backtracked(text[begin:at])
                out += [self.byte_ids[b] for b in c.encode()]
                begin = at + 1
        if begin < len(text):
            out += self.backtracked(text[begin:])
        return np.asarray(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of ``text``, begin and end among them, as little-endian unsigned 32-bit integers."""
        ends = self.vocabulary.begin, self.vocabulary.end
        if text:
            text = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        own = b"".join(map(self.kept.__getitem__, self.stretches.findall(text) if len(text) <= LONG else (m.group() for m in self.stretches.finditer(text))))
        return struct.pack("<I", ends[0]) + own + struct.pack("<I", ends[1])

    def surface(self, i: int) -> bytes:
        kind, piece = self.vocabulary.kinds[i], self.vocabulary.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        return b"" if kind == CONTROL else self.vocabulary.unknown_surface if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def decode(self, ids: bytes) -> str:
        """The text of packed ids. Bytes of no UTF-8 sequence become U+FFFD, one each; the first space is the dummy prefix."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.surfaces):
            raise ValueError(f"no piece has the id {numbers.max()}")
        surfaces, kinds = self.surfaces, self.vocabulary.kinds
        parts, waiting, begun = [], [], False
        for i in numbers.tolist():
            if kinds[i] == CONTROL:  # ends a sequence of bytes
                parts.append(waiting)
                waiting = []
            elif begun or not self.vocabulary.dummy_prefix or kinds[i] != NORMAL:
                waiting.append(surfaces[i])
                begun = True
            else:
                waiting.append(surfaces[i].removeprefix(b" "))
                begun = True
        return "".join(self.text_of(b"".join(p)) for p in [*parts, waiting])

    def text_of(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return re.sub("[\ud800-\udfff]", "�", raw.decode("utf-8", "surrogateescape"))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with n_tokens and ids: those of ``text``, packed as little-endian unsigned 32-bit integers."""
    docs = replaced(docs, {"n_tokens": "long", "ids": "binary"})
    at, names = docs.columns.index("text"), docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in sliced(batches, at, BLOCK_BYTES):
            ids = [own.encode(t.decode()) for t in texts_of(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names)

    return docs.mapInArrow(of, docs.schema)


def decode(coded: DataFrame, path: str, name: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ``ids`` in column ``name``; null ids give the empty text."""
    coded = replaced(coded, {name: "string"})
    at, names = coded.columns.index("ids"), coded.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in sliced(batches, at, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([own.decode(i) for i in texts_of(b.column(at))], pa.string())], names)

    return coded.mapInArrow(of, coded.schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's text, encoded and decoded again."""
    coded = decode(encode(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path).drop("text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
