"""The fill-in-the-middle transformation against a plain version, with the odd cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import infill
from quarrystone.llm.common import flat
from tests.llm.test_operators import docs, empty, odd, texts  # noqa: F401

SPACE = " \t\n\x0b\x0c\r"


def brute(doc_id, text):
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    if h[3] % 100 < 20:
        return n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_report_of_whole_texts(docs, texts):  # noqa: F811
    got = {r.doc_id: tuple(r)[1:] for r in infill.report(docs).collect()}
    want = {i: (*(b := brute(i, t))[:4], sha(b[4]), sha(t or "")) for i, t in texts.items()}
    assert got == want
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 14])
def test_odd_rows_in_chunks_of_any_size(spark, odd, chunk):  # noqa: F811
    rows = [(k, t) for k, t in enumerate(["é<P", "<S", "漢🙂é" * 50, "<P>x", "a<M>", ">x<", "<", "🙂", "a\n", "<S>"] * 6)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    table = odd.where("n_chars is null or n_chars < 1000").select("doc_id", "text").union(more).withColumn("form", F.lit(1)).withColumn("DRAWN", F.lit("d")).withColumn("n", F.lit("n"))
    own = infill.transform(table, chunk=chunk)
    assert own.columns == ["doc_id", "text", "DRAWN", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = own.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert len(out) == table.count()
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.DRAWN == "d"
    assert infill.report(empty(odd)).count() == 0


def test_a_long_text_is_cut_where_it_says(spark):
    text = "漢é a🙂" * 400_000
    r = infill.transform(spark.createDataFrame([(3, text)], "doc_id long, text string")).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(3, text)


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_places_of_units(unit):
    rng = random.Random(6)
    made = ["".join(rng.choice("ab é漢🙂 \n\t") for _ in range(rng.randrange(30))) for _ in range(40)] + ["", " ", "\n", "a", "\n\n"]
    data, ends = flat(pa.array(made))
    find = {"chars": r"(?s).", "words": rf"[^{SPACE}]+", "lines": r"[^\n]*\n|[^\n]+"}[unit]
    for size in (1, 4, 1000):
        chunks = infill.Chunks(data, ends, unit, size)
        for k, text in enumerate(made):
            begins = [len(text[: m.start()].encode()) for m in re.finditer(find, text)]
            assert chunks.units[k] == len(begins)
            ranks = np.arange(len(begins) + 1)
            assert chunks.places(np.full(len(ranks), k), ranks).tolist() == [*begins, len(text.encode())]


def test_cuts_at_words_are_restored(spark, texts):  # noqa: F811
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = infill.transform(table, unit="words", percent=100).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    for r in rows:
        assert r.back == (r.text or "") and r.n == len(re.findall(rf"[^{SPACE}]+", r.text or ""))
