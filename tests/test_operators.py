"""Operators on small rows: nulls, ties, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators import discovery, evidence, picks, quality, state
from quarrystone.sources import sinks
from quarrystone.streaming import usage


def test_latest_per_key_breaks_ties_by_order(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {r.v for r in picks.latest_per_key(df, ["k"], [F.desc("t"), F.asc("v")]).collect()} == {"y", "n"}


def test_ranking_needs_enough_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert picks.ranking(df, [F.desc("v")], 5, 3).count() == 0
    assert [r["rank"] for r in picks.ranking(df, [F.desc("v")], 5, 2).orderBy("rank").collect()] == [1, 2]
    assert picks.ranking(df.limit(0), [F.desc("v")], 5, 1).count() == 0


def test_page_of_nothing_and_beyond_the_end(spark):
    df = spark.range(45)
    last = picks.page(df, [F.asc("id")], 3, 20).collect()
    assert (len(last), last[0].total, last[0].total_pages, last[0].has_next) == (5, 45, 3, False)
    assert picks.page(df, [F.asc("id")], 4, 20).count() == 0


def test_search_is_literal(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",), (None,)], "n string")
    assert [r.n for r in picks.searched(df, " 100% ", ["n"]).collect()] == ["100% sure"]


def test_bins_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (0.0,), (14.9,), (15.0,)], "v double")
    assert [r.b for r in df.select(picks.binned(F.col("v"), [(0, "free"), (15, "low")], "high").alias("b")).collect()] == [None, "free", "low", "high"]


def test_upsert_versions(spark):
    old = spark.createDataFrame([("a", 3, 1.0), ("b", 1, None), ("c", 2, 5.0)], "id string, version_no int, rate double")
    new = spark.createDataFrame([("a", 2.0), ("b", None), ("d", 1.0)], "id string, rate double")
    got = {r.id: (r.event_type, r.version_no, r.changed) for r in state.upsert_versions(old, new, "id", ["rate"]).collect()}
    assert got == {"a": ("Updated", 4, ["rate"]), "b": ("Touched", 1, []), "c": ("Absent", 2, None), "d": ("New", 1, None)}


def test_merge_fills_or_overwrites(spark):
    base, updates = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert {(r.k, r.v) for r in state.merged(base, updates, "k", ["v"]).collect()} == {("a", 2), ("b", 3), ("c", 4)}
    assert {(r.k, r.v) for r in state.merged(base, updates, "k", ["v"], overwrite=False).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_chunks_cover_the_text():
    text = "Para one. " * 40 + "\n\n" + "word " * 300
    spans = evidence.split_text(text, 200, 40)
    assert all(0 < b - a <= 200 for a, b in spans)
    covered = set().union(*(range(a, b) for a, b in spans))
    assert all(i in covered or text[i].isspace() for i in range(len(text)))
    assert evidence.split_text("", 200, 40) == [] and evidence.split_text("   ", 200, 40) == []


def test_chunks_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk) for r in evidence.chunked(df).collect()] == [(3, "short")]
    assert evidence.chunked(df.limit(0)).count() == 0


def test_urls(spark):
    rows = [("HTTP://WWW.Example.com:80//a//b/?utm=1&page=2&id=9#top",), ("https://x.org",), (None,)]
    got = [(r.u, r.h) for r in spark.createDataFrame(rows, "u string").select(tx.url(F.col("u")).alias("u"), tx.host(F.col("u")).alias("h")).collect()]
    assert got == [("http://www.example.com/a/b?id=9&page=2", "example.com"), ("https://x.org", "x.org"), (None, None)]


def test_words_to_values(spark):
    df = spark.createDataFrame([("4.49%", "No monthly fee", "1.5 years", "Apr 9, 2025"), ("x", "$1,200.50", "90-day", "2025-04-09"), (None, None, None, None)], "r string, f string, t string, d string")
    got = df.select(tx.number(F.col("r")).alias("r"), tx.fee(F.col("f")).alias("f"), tx.term_days(F.col("t")).alias("t"), tx.day(F.col("d")).alias("d")).collect()
    day = dt.date(2025, 4, 9)
    assert [tuple(x) for x in got] == [(4.49, 0.0, 548, day), (None, 1200.5, 90, day), (None, None, None, None)]


def test_severity_and_conflicts(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "id int, fee double")
    codes = quality.issue_codes([("b_high", F.col("fee") > 10), ("a_missing", F.col("fee").isNull())])
    got = [(r.s, r.c) for r in df.select(quality.severity(codes, ["b_high"]).alias("s"), codes.alias("c")).collect()]
    assert got == [("warning", ["a_missing"]), ("pass", []), ("error", ["b_high"])]


def test_snapshot_replacement_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "CA"), (2, "US")], "v int, c string"), path, ["c"])
    sinks.replace_partitions(spark.createDataFrame([(9, "CA")], "v int, c string"), path, ["c"])
    assert {(r.v, r.c) for r in spark.read.parquet(path).collect()} == {(9, "CA"), (2, "US")}




def test_stream_gives_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    events.union(events.limit(50)).repartition(3).write.parquet(src)
    stream = usage.distinct(usage.events(spark, src), "event_id", "60 days")
    usage.into_parquet(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(out).select("event_id").distinct().count() == events.count() == spark.read.parquet(out).count()
    query = usage.daily(usage.events(spark, src)).writeStream.format("memory").queryName("days").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count() + 50


def test_stream_of_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 7), (2, "2024-01-01 10:20:00", 7), (3, "2024-01-01 11:00:00", 7), (4, "2024-01-01 10:00:00", 8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    df.write.parquet(str(tmp_path / "src"))
    query = usage.sessions(usage.events(spark, str(tmp_path / "src"))).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(7, 1), (7, 2), (8, 1)]


def test_links_of_odd_pages(spark):
    rows = [(1, "http://www.a.example/x", '<a href="/p">p</a><A class=b HREF=\'http://a.example/f.PDF?x=1\'>f</A><a href="/p">again</a><a href="mailto:x@y">m</a><a href="">e</a><a href="#t">t</a><a href="http://b.example/">b</a>'), (2, None, None), (3, "u", "")]
    got = {(r.page_id, r.target): (r.kind, r.internal) for r in discovery.links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "/p"): ("html", True), (1, "http://a.example/f.PDF?x=1"): ("pdf", True), (1, "mailto:x@y"): ("excluded", False), (1, ""): ("empty", True), (1, "#t"): ("anchor", True), (1, "http://b.example/"): ("html", False)}


def test_page_evidence_has_a_floor(spark):
    rows = [(1, "http://h/loan", "<title>Loan</title><h1>A loan</h1>loan"), (2, "http://h/", "login cookie careers"), (3, None, None)]
    got = {r.page_id: (r.score, r.reasons) for r in discovery.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"), ["loan"], ["login", "cookie", "careers"]).collect()}
    assert got == {1: (8, ["title", "heading", "url", "body"]), 2: (0, ["negative"]), 3: (0, [])}


def test_contract_takes_the_first_usable_field(spark):
    df = spark.createDataFrame([(1, "s", None, 2.0), (2, "s", 1.0, 2.0), (3, "s", None, None), (4, "other", None, None), (5, None, None, None)], "id int, kind string, a double, b double")
    got = {r.id: (r.met, r.missing, r.complete) for r in discovery.comparison_contract(df, "kind", {"s": {"rate": ["a", "b"]}}).collect()}
    assert got == {1: (["b"], [], True), 2: (["a"], [], True), 3: ([], ["rate"], False), 4: ([], [], True), 5: ([], [], True)}


def test_siblings_need_two(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("b", 2, True), ("c", 1, None)], "k string, n int, v boolean")
    assert sorted((r.k, r.n, r.sibling) for r in discovery.siblings(df, "k", "n", F.col("v")).collect()) == [("a", 1, True), ("a", 3, True), ("b", 1, False), ("c", 1, False)]


def test_nearest_takes_queries_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, float(i * i % 11)]) for i in range(60)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b))
    found = evidence.nearest(vectors, vectors.where("vec_id % 2 = 0"), 3, 4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, round(c, 9)) for q in range(0, 60, 2) for c in sorted((cosine(rows[v], rows[q]) for v in rows if v != q), reverse=True)[:3]}
    got = found.collect()
    assert len(got) == 90 and {(r.query_id, round(r.cosine, 9)) for r in got} == want


def test_nearest_keeps_order_among_copies_and_missing_vectors(spark):
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(40)] + [(99, None), (100, [5.0, 1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = evidence.nearest(vectors, vectors.where("vec_id in (0, 5, 99, 100)"), 5, 2, 7)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {q: [r.vec_id for r in sorted((r for r in found.collect() if r.query_id == q), key=lambda r: r["rank"])] for q in (0, 5, 99, 100)}
    assert got == {0: [3, 6, 9, 12, 15], 5: [2, 8, 11, 14, 17], 99: [0, 1, 2, 3, 4], 100: [0, 3, 6, 9, 12]}
