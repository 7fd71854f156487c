"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own text. A text is compressed
once with every dictionary, in pieces short enough that the dictionary matters in each, and
belongs to the language whose dictionary makes it smallest. Where the two smallest sizes are
too close the text can be rejected. Case and everything that is neither an ASCII letter nor
beyond ASCII tell nothing of the language: texts are lower-cased, and runs of the rest
become one space.

* Dictionaries are fitted on a bounded sample of labelled rows: some ``PER_LANGUAGE`` documents
  of each language (expected number; those with the smallest hash of their id) among those of
  at most ``LONGEST`` bytes, each of them whole. Both bounds are parameters; predictions read
  whole texts.
* ``und`` is returned for a null text and for one without any letter, with score 0; so it is
  for every text where no document has a language to learn.
* Rows are never dropped by ``predict``; repeated rows are repeated; columns other than those
  named are not read. Equal sizes go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import held_out, sliced, texts_of

PER_LANGUAGE, LONGEST = 100, 4096
LEVEL, PIECE = 6, 4096
#: Share of the second smallest size below which a margin is narrow.
NARROW = 0.002
UNKNOWN = "und"


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> dict[str, bytes]:
    """Dictionary content by language, from documents that are not held out and have a language."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") <= longest))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # the hash of an id lies in 0 .. 2**31 - 1; the documents below a language's limit are its sample
    limits = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_language / n) * 2**31)))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**31))
    # an id that very many rows have is one document
    sample = rows.where(drawn < limits[F.col("lang")]).groupBy("lang", "doc_id", drawn.alias("drawn")).agg(F.min("text").alias("text")).collect()
    own: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(sample, key=lambda r: (r["drawn"], r["text"])):
        own[r["lang"]].append(letters(r["text"].encode()))
    return {lang: c for lang, texts in own.items() if (c := b"\n".join(texts).strip())}


_SPACED = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: bytes) -> bytes:
    """Lower case, with runs of ASCII characters that aren't letters as one space."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_SPACED).split())


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Sizes:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(compression_params=params, dict_data=own))

    def of(self, text: bytes) -> list[int]:
        """One size for each language; at least one piece, so that no size is zero."""
        pieces = [text[i : i + PIECE] for i in range(0, max(1, len(text)), PIECE)]
        return [sum(len(z.compress(p)) for p in pieces) for z in self.by]

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language, and the margin: how much smaller the smallest size is than the second."""
        if not self.by or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.by) == 1:
            return self.langs[0], 1.0
        sizes = self.of(letters(text))
        first, second = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]
        return self.langs[first], 1 - sizes[first] / sizes[second]


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the margin of the two smallest sizes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(content)
        for b in sliced(batches, 2):
            found = [sizes.predict(t) for t in texts_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, content: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """The rows of ``docs`` whose text has a language by a margin that isn't narrow."""
    names = docs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(content)
        at = names.index("text")
        for b in sliced(batches, at):
            kept = [lang != UNKNOWN and score >= narrow for lang, score in map(sizes.predict, texts_of(b.column(at)))]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
