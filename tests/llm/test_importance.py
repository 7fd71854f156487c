"""Importance resampling against a plain version, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.llm import importance
from tests.llm.test_operators import SF, docs, empty, odd  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text):
    words = words_of(text)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, targets):
    """(doc_id, n_features, weight, score, rank), sorted."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets_of(text))
    for text in targets:
        t.update(buckets_of(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        own = buckets_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(list(r)) for r in df.collect())


def test_whole_tables(spark, docs):  # noqa: F811
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()])
    assert got(importance.resampled(docs, benchmark)) == want
    assert sum("None" not in r for r in want) >= 8


def test_odd_rows(spark, odd):  # noqa: F811
    rng = random.Random(8)
    rows = [(i % 90, " ".join(rng.choice(["Äpfel", "a", "B", "c9", "漢字"]) for _ in range(rng.randrange(45)))) for i in range(120)]
    table = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("score", F.lit("x")).withColumn("part", F.lit(0)).withColumn("row", F.lit(0))
    targets = ["a b c9", None, "", "ÄPFEL äpfel word word"]
    benchmark = spark.createDataFrame([(t, 1) for t in targets], "text string, bucket int")
    found = importance.resampled(table, benchmark)
    # repeated rows change ranks among themselves only
    assert got(found) == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], targets)
    assert importance.resampled(empty(table), benchmark).count() == 0
    assert got(importance.resampled(table, empty(benchmark))) == brute([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], [])


def test_equal_rows_without_ids_are_all_ranked(spark):
    table = spark.createDataFrame([(None, "word " * 30)] * 400, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resampled(table, table).collect() if r["rank"])
    assert ranks == list(range(1, 21))


def test_suffix_arrays_sort_and_share():
    rng = random.Random(9)
    for size in (1, 2, 3, 5):
        made = ["".join(rng.choice("ab ,C") for _ in range(rng.randrange(25))) for _ in range(30)] + ["", None, "a", "x"]
        own = importance.Features(pa.array(made), size, 1 << 32)
        found = Counter(zip(own.place.tolist(), own.bucket.tolist(), strict=True))
        want = Counter((k, zlib.crc32(" ".join(w[i : i + n]).encode())) for k, text in enumerate(made) for w in [words_of(text)] for n in range(1, size + 1) for i in range(len(w) - n + 1))
        assert found == want and own.words.tolist() == [len(words_of(t)) for t in made]
    ids, text = np.array([2, 1, 2, 1, 2, 1, 3]), np.array([0, 0, 0, 1, 1, 1, 1])
    order, shared = importance.suffixes(ids, text, 3)
    assert order.tolist() == [1, 3, 5, 2, 0, 4, 6] and shared.tolist() == [0, 2, 1, 0, 1, 2, 0]
    order, shared = importance.suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64), 3)
    assert len(order) == len(shared) == 0


def test_hashing_once_a_run(monkeypatch):
    hashed = []
    monkeypatch.setattr(importance.zlib, "crc32", lambda b: hashed.append(bytes(b)) or 7)
    importance.Features(pa.array(["a b a b a b", "b a b"]))
    assert sorted(hashed) == sorted([b"a", b"b", b"a b", b"b a", b"a b a", b"b a b"])
