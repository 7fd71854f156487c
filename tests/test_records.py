"""Filters, files, sinks and gates on small inputs."""

import datetime
import json

from pyspark.sql import functions as F

from quarrystone.functions import filters
from quarrystone.functions import text as tx
from quarrystone.operators import gates, picks, state
from quarrystone.plans import records
from quarrystone.sources import files, sinks


def test_filters_take_defaults():
    got = filters.normalised(locale="FR", country_code=" us ", product_types=["GIC", "gic ", "bonds"], states=["x"], sort_by="rate; drop", sort_order="ASC", sorts=["name", "rate"], page=0, page_size=1000)
    assert got == filters.ListFilters("en", "US", ("gic",), filters.RUN_STATES, "name", False, 1, 100)
    assert [filters.country(v) for v in (None, "c4", "CAN", "kr")] == ["CA", "CA", "CA", "KR"]


def test_registry_files_and_objects(spark, tmp_path):
    for bank in ("b1", "b2"):
        (tmp_path / f"{bank}.json").write_text(json.dumps({"bank_code": bank, "sources": [{"source_id": f"{bank}-{k}", "url": "https://x/", "discovery_role": "detail"} for k in range(2)]}, indent=1))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.bin").write_bytes(b"%PDF")
    assert {(r.bank_code, r.source_id) for r in files.registries(spark, f"{tmp_path}/*.json").collect()} == {(b, f"{b}-{k}") for b in ("b1", "b2") for k in range(2)}
    assert {(r.key, bytes(r.body)) for r in files.objects(spark, f"file:{tmp_path}", "*.bin").collect()} == {("deep/a.bin", b"%PDF")}
    assert files.discarded(spark, "a int, b string").columns == ["a", "b"] and files.discarded(spark, "a int").count() == 0


def test_merges_keep_other_columns_and_readers(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("a", 1, "x"), (None, 5, "n")], "k string, v int, other string").write.parquet(path)
    first = sinks.merge_into(spark, spark.createDataFrame([("a", 2), ("b", 3), (None, 9)], "k string, v int"), path, "k", ["v"])
    second = sinks.merge_into(spark, spark.createDataFrame([("b", 4)], "k string, v int"), path, "k", ["v"])
    rows = lambda p: sorted(((r.k, r.v, r.other) for r in spark.read.parquet(p).collect()), key=str)
    assert first != second and rows(first) == sorted([("a", 2, "x"), ("b", 3, None), (None, 5, "n"), (None, 9, None)], key=str)
    assert ("b", 4, None) in rows(second) and ("a", 1, "x") in rows(second)


def test_one_change_set_for_two_tables(spark):
    a, b = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (None, "z", 0)], "k int, s string, n int"), spark.createDataFrame([(1, "q"), (1, "q")], "k int, s string")
    x, y = sinks.changed_in_both(a, b, spark.createDataFrame([(1, None), (7, "w")], "k int, s string"), "k", ["s"])
    assert {tuple(r) for r in x.collect()} == {(1, None, 0), (2, "y", 0), (None, "z", 0)} and [tuple(r) for r in y.collect()] == [(1, None), (1, None)]


def test_json_artefacts(spark, tmp_path):
    sinks.as_json(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":1}', '{"a":2,"b":"x"}']


def test_followed_needs_only_neighbours_in_time(spark):
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    a = spark.createDataFrame([("k", 1, at(0)), ("k", 2, at(19)), (None, 3, at(0))], "key string, a int, at timestamp")
    b = spark.createDataFrame([("k", n, at(n)) for n in (0, 1, 20, 21, 39, 40)] + [(None, 1, at(1))], "key string, b int, next timestamp")
    got = state.followed(a, b, "key", "at", "next", 20, F.col("next") > F.col("at"))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 1), (1, 20), (2, 20), (2, 21), (2, 39)}
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_period" in joined and "_held" in joined


def test_retained_ranks_no_more_than_it_keeps(spark):
    df = spark.createDataFrame([("g", k) for k in range(10)] + [(None, 99)], "g string, k int")
    got = state.retained(df, ["g"], [F.desc("k")], 2, F.col("k") == 0, "k")
    assert {r.k for r in got.where("kept").collect()} == {9, 8, 0, 99} and "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_shown_instead_where_nothing_passes(spark):
    df = spark.range(9)
    assert [(r.id, r.signal) for r in picks.or_top(df, F.col("id") > 6, [F.desc("id")], 20, 3).collect()] == [(8, "warning"), (7, "warning")]
    assert sorted((r.id, r.signal) for r in picks.or_top(df, F.col("id") > 60, [F.desc("id")], 20, 3).collect()) == [(6, "info"), (7, "info"), (8, "info")]


def test_grounded_quotes(spark):
    rows = [("Annual  FEE applies", "the annual fee applies here", True), ("short", "short words", False), ("fee ... applies", "fee ... applies", False), (None, "x", None)]
    df = spark.createDataFrame(rows, "q string, e string, w boolean")
    assert all(r.y == r.w for r in df.select("w", gates.grounded(F.col("q"), F.col("e")).alias("y")).collect())


def test_preserved_scenarios(spark):
    groups = [["down payment"], ["ltv", "loan to value"]]
    rows = [("5% with LTV of 80", "5% at a loan to value of 80", True), ("5%", "5% with a down payment", False), ("", "down payment", True), (None, None, True)]
    df = spark.createDataFrame(rows, "s string, e string, w boolean")
    assert all(r.y == r.w for r in df.select("w", gates.preserved(F.col("s"), F.col("e"), groups).alias("y")).collect())


def test_stale_days_and_terms(spark):
    df = spark.createDataFrame([("Rates as of 2019-2-3 apply", datetime.date(2019, 2, 3)), ("rate as of 2019-02-31", None), ("as of 2019-02-03", None), (None, None)], "e string, w date")
    assert all(r.y == r.w for r in df.select("w", gates.as_of(F.col("e")).alias("y")).collect())
    terms = [(365, "1 year", False), (390, "1 year", False), (400, "1 year", True), (200, "90 days to 12 months", False), (30, "open", False)]
    df = spark.createDataFrame(terms, "d int, t string, w boolean")
    assert all(r.y == r.w for r in df.select("w", gates.term_conflict(F.col("d"), F.col("t")).alias("y")).collect())


def test_source_urls_and_domains(spark):
    urls = {"HTTPS://Bank.example.COM:443//a//b/?zip=2&utm=1&Product=x#f": "https://bank.example.com/a/b?product=x&zip=2", "http://x.org": "http://x.org/", "https://x.org/rates?cid=1&state=": "https://x.org/rates?cid=1", "https://x.org/a?cid=1": "https://x.org/a", "ftp://x.org/": None, "": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.y for r in df.select("u", tx.source_url(F.col("u")).alias("y")).collect()} == urls
    domains = {"https://www.Bank.com/x": "bank.com", "bank.ca/y": "bank.ca", "http://10.0.0.1/": None, "http://localhost:80": None, "intranet": None, "": None}
    df = spark.createDataFrame([(u,) for u in domains], "u string")
    assert {r.u: r.y for r in df.select("u", tx.official_domain(F.col("u")).alias("y")).collect()} == domains


def test_an_export_holds_all_evidence_and_products_of_a_bank_in_order(spark, monkeypatch):
    ids = sorted(f"P{k}" for k in range(230))
    tables = {"product": spark.createDataFrame([("B1", p, "active") for p in ids] + [("B2", "P1", "active"), ("B2", "P9", "inactive")], "bank_code string, product_id string, status string"), "version": spark.createDataFrame([("P7", k, "N") for k in range(9, 0, -1)], "product_id string, version_no int, note string")}
    monkeypatch.setattr(records, "read", lambda spark, sf_dir, name: tables[name])
    rows = records.result_export(spark, "").collect()
    own = sorted((r for r in rows if r.bank_code == "B1"), key=lambda r: r.part)
    assert [r.part for r in own] == [0, 1, 2] and {r.n for r in own} == {230} and [(r.n, json.loads(r.export)) for r in rows if r.bank_code == "B2"] == [(1, [{"product_id": "P1", "evidence": []}])]
    whole = [p for r in own for p in json.loads(r.export)]
    assert [p["product_id"] for p in whole] == ids and [e["no"] for p in whole if p["product_id"] == "P7" for e in p["evidence"]] == list(range(1, 10))


def test_followed_works_out_what_pairs_are_asked_before_they_meet(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    a, b = spark.createDataFrame([("k", n, at(n)) for n in range(0, 400, 7)], "key string, a int, at timestamp"), spark.createDataFrame([("k", n, at(n)) for n in range(0, 500, 3)], "key string, b int, next timestamp")
    got = state.followed(a, b, "key", "at", "next", 5, F.col("next") > F.col("at"))
    assert {(r.a, r.b) for r in got.collect()} == {(n, m) for n in range(0, 400, 7) for m in range(0, 500, 3) if n < m <= n + 120}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "make_interval" not in plan.split("Join", 1)[1].split("\n", 1)[0] and "_until" in plan


def test_followed_writes_its_pairs_in_an_order_that_files_hold_small(spark, monkeypatch, tmp_path):
    at = "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 50 AS int))"
    a = spark.range(4000).selectExpr("concat('K', id DIV 50 % 2) AS key", "concat('R', 1000000 + id) AS a", f"{at} AS at").orderBy(F.xxhash64("a"))
    b = a.select("key", F.col("a").alias("b"), F.col("at").alias("next"))
    later = (F.col("next") > F.col("at")) | ((F.col("next") == F.col("at")) & (F.col("b") > F.col("a")))
    state.followed(a, b, "key", "at", "next", 20, later).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    n = 2 * (sum(40 * 40 * min(20, 49 - d) for d in range(50)) + 50 * 40 * 39 // 2)
    assert pairs.columns == ["key", "a", "at", "b", "next"] and pairs.count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n * 0.4


def test_followed_deals_rows_once_to_tasks_by_their_number_and_joins_lists(spark, monkeypatch):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    a, b = spark.createDataFrame([("k", n, day(n % 200)) for n in range(1000)], "key string, a int, at timestamp"), spark.createDataFrame([("k", n, day(n % 200)) for n in range(1000)], "key string, b int, next timestamp")
    monkeypatch.setattr(state, "DEALT", (100, 100), raising=False)
    monkeypatch.setattr(state, "LISTED", 2, raising=False)
    got = state.followed(a, b, "key", "at", "next", 20, (F.col("next") > F.col("at")) | (F.col("b") > F.col("a")))
    want = {(n, m) for n in range(1000) for m in range(1000) if n % 200 < m % 200 <= n % 200 + 20 or (n % 200 == m % 200 and m > n)}
    rows = got.collect()
    assert {(r.a, r.b) for r in rows} == want and len(rows) == len(want) and {(r.a, r["at"], r.key) for r in rows} == {(n, day(n % 200), "k") for n, _ in want}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert got.rdd.getNumPartitions() == 20 and plan.count("hashpartitioning(") == 2
    assert plan.index("Generate inline") < plan.index("Coalesce") < plan.index("SortMergeJoin")
