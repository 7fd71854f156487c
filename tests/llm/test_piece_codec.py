"""Encoding and decoding by pieces against the library, with the odd cases."""

import hashlib
import random
import struct

import numpy as np
import pytest
import public_tokenizers
import sentencepiece

from quarrystone.llm import piece_codec
from tests.llm.test_operators import docs, empty, odd, texts  # noqa: F401

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(PATH)


def encoded(library, text):
    return library.encode(text, add_bos=True, add_eos=True)


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_codec_is_the_librarys(codec, library):
    rng, pieces = random.Random(3), list(codec.ids)
    letters = "  ab  tthe\n\t▁éñ漢字🙂ด\x00\x7f<>s/_-=0123aaaa        ineronst"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) * rng.choice([1, 1, 5]) for _ in range(2000)]
    made += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(2000)]
    made += ["", " ", "   ", "\n", "▁", "<s></s><unk><0x41>", "a" * 50_000, "漢" * 20_000, " " * 20_000, "aB9/" * 10_000, "\U0010ffff\ue000"]
    for text in made:
        own = codec.encode(text)
        assert numbers(own) == encoded(library, text), text[:80]
        assert codec.decode(own) == library.decode(numbers(own)), text[:80]


def test_decoding_of_any_ids_is_the_librarys(codec, library):
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32_000), 28705, 259, 264]) for _ in range(rng.randrange(8))]
        assert codec.decode(np.asarray(ids, "<u4").tobytes()) == library.decode(ids), ids
    with pytest.raises(ValueError):
        codec.decode(struct.pack("<I", 32_000))


def test_backtracking_is_merging(codec):
    """Where a longest piece is no part of the result, pieces are taken back."""
    rng, pieces = random.Random(5), [p for p in codec.ids if "▁" not in p]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(4))
        assert [codec.vocabulary.pieces[i] for i in codec.backtracked(text)] == codec.merged(text)


def test_forgotten_stretches_and_neighbours_change_nothing(monkeypatch, codec, texts):  # noqa: F811
    monkeypatch.setattr(piece_codec, "KEPT", 50)
    monkeypatch.setattr(piece_codec, "PAIRS", 10)
    small = piece_codec.Codec(PATH)
    for text in list(texts.values())[:20]:
        assert small.encode((text or "")[:3000]) == codec.encode((text or "")[:3000])


def test_other_vocabularies_are_refused(tmp_path):
    with open(PATH, "rb") as file:
        model = file.read()
    ruled = tmp_path / "ruled.model"
    ruled.write_bytes(model + b"\x1a\x05\x12\x03abc")  # a normaliser with rules, in place of the one before
    with pytest.raises(ValueError):
        piece_codec.Codec(str(ruled))
    by_score = tmp_path / "by_score.model"
    by_score.write_bytes(model + b"\x12\x02\x18\x01")  # another type of vocabulary
    with pytest.raises(ValueError):
        piece_codec.Codec(str(by_score))


def test_report_of_whole_texts(docs, texts, library):  # noqa: F811
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.report(docs, PATH).collect()}
    want = {}
    for i, text in texts.items():
        ids = encoded(library, text or "")
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_columns_and_odd_rows(odd, library):  # noqa: F811
    from pyspark.sql import functions as F

    clashing = odd.withColumn("ids", F.lit("x")).withColumn("N_tokens", F.lit("y")).withColumn("decoded", F.lit(1)).withColumn("A b", F.lit("kept"))
    coded = piece_codec.encode(clashing, PATH)
    back = piece_codec.decode(coded, PATH)
    assert back.columns == [*(c for c in clashing.columns if c.lower() not in ("ids", "n_tokens", "decoded")), "n_tokens", "ids", "decoded"]
    rows = back.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert numbers(bytes(r.ids)) == encoded(library, r.text or "") and r.n_tokens == len(r.ids) // 4
        assert r.decoded == (r.text or "") and r["A b"] == "kept" and r.words == 1
    assert piece_codec.report(empty(odd), PATH).count() == 0
