"""Discovery by links, pages of several products, and parsing that is done once."""

import random

import pytest

from quarrystone.operators import frontier, increments, sections, variants
from quarrystone.sources import adapters


def brute(links, registry, domains, depth):
    """Sources and warnings by a walk over dictionaries."""
    kind = lambda u: "pdf" if u.split("?")[0].lower().endswith(".pdf") else "html"

    def code(u):
        rest = u.split("://", 1)[1].split("?")[0].lower()
        for name, words in frontier.EXCLUDED:
            if any(w in rest for w in words):
                return name
        host = rest.split("/")[0]
        return None if any(host == d or host.endswith(f".{d}") for d in domains) else "cross_domain_link"

    by_url = {(u, t): i for i, u, t, _ in registry}
    found = {i: (0, None) for i, _, _, r in registry if r == "entry"}
    for step in range(1, depth + 1):
        pages = {u for i, u, t, _ in registry if i in found and found[i][0] == step - 1 and t == "html"}
        new = {}
        for a, b in sorted((a, b) for a, b in links if b):
            if a in pages and not code(b) and (i := by_url.get((b, kind(b)))) is not None and i not in found:
                new.setdefault(i, (step, a))
        found |= new
    followed = {u for i, u, t, _ in registry if i in found and found[i][0] < depth and t == "html"}
    warned = {(a, code(b) or "out_of_registry_link", b) for a, b in links if b and a in followed and (code(b) or (b, kind(b)) not in by_url)}
    return {(i, *found.get(i, (None, None)), "seed_only" if i not in found else "discovered" if found[i][0] else "selected") for i, *_ in registry}, warned


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_discovery_is_that_of_brute_force(spark, depth):
    rng = random.Random(depth)
    registry = [(i, f"https://bank.example/{'doc' if i % 5 == 4 else 'p'}{i}{'.pdf' if i % 5 == 4 else ''}", "pdf" if i % 5 == 4 else "html", "entry" if i in (0, 7) else "detail") for i in range(30)]
    urls = [u for _, u, _, _ in registry] + ["https://bank.example/unknown", "https://bank.example/compare/x", "https://www.other.example/x", "https://bank.example/promo", "https://my.bank.example/login", "https://notbank.example/p1", None]
    links = [(rng.choice(urls[:30]), rng.choice(urls)) for _ in range(60)] + [(urls[0], urls[0]), (urls[0], urls[3]), (urls[0], urls[3])]
    sources, warnings = frontier.discover(spark.createDataFrame(links, "from_url string, target_url string"), spark.createDataFrame(registry, "source_id long, url string, source_type string, role string"), ["bank.example"], depth)
    want, warned = brute(links, registry, ["bank.example"], depth)
    assert {(r.source_id, r.depth, r.discovered_on, r.status) for r in sources.collect()} == want
    assert {tuple(r) for r in warnings.collect()} == warned


def test_discovery_of_empty_tables(spark):
    links, registry = spark.createDataFrame([], "from_url string, target_url string"), spark.createDataFrame([(1, "u", "html", "entry"), (2, "v", "html", "detail")], "source_id long, url string, source_type string, role string")
    sources, warnings = frontier.discover(links, registry)
    assert {(r.source_id, r.status) for r in sources.collect()} == {(1, "selected"), (2, "seed_only")} and warnings.count() == 0
    sources, warnings = frontier.discover(links, registry.limit(0))
    assert sources.count() == 0 and warnings.count() == 0


CARD = "<h2>{}</h2><p>Annual fee: ${}</p><p>Purchase rate: {}%</p>"
LINE = "<h2>{}</h2><p>Prime + 2%</p><p>Limit from $5,000</p><p>Interest only</p><p>Secured by your home</p>"


def test_pages_of_several_products(spark):
    pages = [
        (1, "credit-card", CARD.format("Gold", "1,200", 19.99) + CARD.format("Silver", 0, 20)), (2, "credit-card", CARD.format("Gold", 12, 19.99)), (3, "credit-card", CARD.format("Gold", 12, 19.99) + "<h2>Silver</h2><p>Annual fee: $9</p>"),
        (4, "credit-card", CARD.format("Gold", 12, 19.99) + CARD.format("GOLD", 13, 18)), (5, "mortgage", CARD.format("Gold", 12, 19.99) + CARD.format("Silver", 0, 20)), (6, "credit-card", CARD.format("Overview", 1, 2) + CARD.format("Silver", 0, 20)),
        (7, "line-of-credit", LINE.format("Home Line") + LINE.format("Student Line").replace("Secured by your home", "Unsecured") + LINE.format("Plain").replace("Limit", "Amount")), (8, "credit-card", None), (9, None, CARD.format("Gold", 1, 2) * 2),
        (10, "credit-card", "<h2>Gold</h2><p>Annual fee: $5</p><h2>Silver</h2><p>Purchase rate: 5%</p>" + CARD.format("Bronze", 1, 2)),
    ]
    df = spark.createDataFrame(pages, "page_id long, product_type string, html string")
    rows = variants.variants(sections.sections(df), df.select("page_id", "product_type")).collect()
    got = {(r.page_id, r.product_name): (dict(r.fields), r.n_variants) for r in rows}
    assert got == {
        (1, "Gold"): ({"annual_fee": "1,200", "purchase_interest_rate": "19.99"}, 2), (1, "Silver"): ({"annual_fee": "0", "purchase_interest_rate": "20"}, 2),
        (7, "Home Line"): ({"interest_rate_summary": "Prime + 2%", "credit_limit_text": "Limit from $5,000", "minimum_payment_text": "Interest only", "security_requirement": "Secured by your home"}, 2),
        (7, "Student Line"): ({"interest_rate_summary": "Prime + 2%", "credit_limit_text": "Limit from $5,000", "minimum_payment_text": "Interest only", "security_requirement": "Unsecured"}, 2),
    }
    parts = {(r.page_id, r.section_index): r.text for r in sections.sections(df).collect()}
    for r in rows:
        assert all(quote in parts[r.page_id, r.section_index] and r.fields[f] in quote for f, quote in r.quotes.items())
    assert len({r.candidate_key for r in rows}) == 4


def test_a_second_run_parses_nothing(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    pages = spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (2, "<h1>a</h1><p>b</p>"), (3, None), (4, ""), (5, "<p>x</p>"), (5, "<p>y</p>")], "page_id long, html string")
    counts = lambda df: {k: df.where(f"action = '{k}'").count() for k in ("stored", "reused")}
    first = increments.parse(pages.where("page_id < 4"), store, "v1")
    assert counts(first) == {"stored": 3, "reused": 0}
    again = increments.parse(pages, store, "v1")
    assert counts(again) == {"stored": 2, "reused": 4} and counts(first) == {"stored": 3, "reused": 0}
    before = increments.parsed(spark, store).count()
    assert counts(increments.parse(pages, store, "v1")) == {"stored": 0, "reused": 6} and increments.parsed(spark, store).count() == before
    assert counts(increments.parse(pages, store, "v2")) == {"stored": 6, "reused": 0}
    rows = increments.parsed(spark, store).collect()
    for version in ("v1", "v2"):
        own = sorted((r.anchor, r.text) for r in rows if r.parser_version == version)
        assert own == [("", ""), ("a", "a\nb"), ("document", "Document\nx"), ("document", "Document\ny")]


def test_known_snapshots_are_read_from_their_version_alone(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    pages = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    for version in ("v1", "v2"):
        increments.parse(pages, store, version)
    known = increments.parsed(spark, store).where("parser_version = 'v2'").select("snapshot_id")
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(parser_version" in plan and "ReadSchema: struct<snapshot_id:string>" in plan


def test_dear_rows_are_dealt_to_all_cores(spark):
    one = spark.range(0, 1000, 1, 1)
    parts = lambda n, **o: adapters.dealt(spark.range(0, n, 1, 1), **o).rdd.getNumPartitions()
    assert [parts(n, most=100, least=10) for n in (5, 20, 60, 750, 1000, 1801)] == [1, 2, 6, 8, 10, 19]
    assert {r.id for r in adapters.dealt(one, 100, 10).collect()} == set(range(1000))


@pytest.mark.parametrize("name", sorted(adapters.DEALT))
def test_relations_of_few_row_groups_are_dealt(spark, name):
    base = adapters.read(spark, "/root/testdata/sf0.01", adapters.DEALT[name])
    assert base.rdd.getNumPartitions() == 1 and adapters.read(spark, "/root/testdata/sf0.01", name).rdd.getNumPartitions() > 1


def test_versions_are_sorted_in_more_tasks_the_more_rows_there_are(spark, monkeypatch):
    from quarrystone.plans import supplements

    monkeypatch.setattr(adapters, "SORTED", (1000, 1000))
    monkeypatch.setattr(supplements, "SORTED", (1000, 1000))
    plan = supplements.version_events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({key}" in plan and f"{n}), REPARTITION_BY_NUM" in plan for key, n in (("l_partkey", 6), ("product_id", 6)))
