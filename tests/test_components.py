"""Links and texts of page components."""

import json
import re
from html import unescape
from urllib.parse import urljoin, urlsplit

import pytest

from quarrystone.operators import components

SF = "/root/testdata/sf0.001"
CATALOGUE = {
    "products": [
        {"name": "Cash Rewards", "learnMore": {"path": "products/cash-back/"}},
        {"title": "Travel Rewards", "url": "https://www.bank.example/cards/travel/"},
        {"title": "Travel Pricing", "disclosureUrl": "/disclosures/card?offerId=travel-42&locale=en_US"},
        {"title": "Template", "href": "/products/{productId}/"},
        {"headline": "Fixed Mortgage", "cta": {"more": [{"targetUrl": "/mortgages/fixed/"}]}},
        {"title": "Picture", "_path": "/assets/card.png"},
    ]
}
WRAPPED = {
    "componentName": "ProductCard",
    "fields": {"Title": {"jsonValue": {"value": "Essential Chequing"}}, "Link": {"jsonValue": {"value": {"text": "Details", "url": "/public-sites/www/Home/Essential", "href": "/bank/essential"}}}},
}


def page(payload, how="script"):
    text = json.dumps(payload)
    return f'<script type="application/json" id="s">{text}</script>' if how == "script" else f"<div data-catalogue='{text}'></div>"


@pytest.mark.parametrize("how", ["script", "attribute"])
def test_links_of_json_have_the_titles_beside_them(how):
    assert [(path, target, label) for _, path, target, label in components.links_of(page(CATALOGUE, how))] == [
        ("products.learnMore.path", "products/cash-back/", "Cash Rewards"),
        ("products.url", "https://www.bank.example/cards/travel/", "Travel Rewards"),
        ("products.disclosureUrl", "/disclosures/card?offerId=travel-42&locale=en_US", "Travel Pricing"),
        ("products.cta.more.targetUrl", "/mortgages/fixed/", "Fixed Mortgage"),
    ]


def test_a_route_in_a_wrapper_has_the_title_above_and_no_alias():
    assert components.links_of(page(WRAPPED)) == [("script", "fields.Link.jsonValue.value.href", "/bank/essential", "Essential Chequing")]


def test_links_of_anchors_and_attributes():
    html = """<a href="/one">One <b>two</b></a><a href='#top'>no</a><a href=mailto:x>no</a><a name="x">no</a><a href="/open">left open<a href="three">3</a>
<div data-cardName="Cash &amp; Back*" data-cardDescriptionUrl="/content/site/ca/en/cash-back.html" data-cardType="cc"></div><div data-url="not a route"></div>
<script>{"title": "no", "url": "/no"}</script><script type="application/json" src="x">{"url": "/no"}</script><script type="application/json">{broken</script>"""
    assert components.links_of(html) == [
        ("anchor", "a", "/one", "One two"), ("anchor", "a", "/open", "left open"), ("anchor", "a", "three", "3"), ("attribute", "data-carddescriptionurl", "/ca/en/cash-back", "Cash & Back*"),
    ]
    assert components.links_of("") == [] and components.links_of("<a href='/x'>open at the end") == [("anchor", "a", "/x", "open at the end")]


def test_texts_of_components():
    prices = {"productName": "Travel Card", "purchaseApr": "19.49% to 29.49% variable APR", "annualFee": "$0", "rateCard": {"label": "Savings APY", "value": "4.10%"}}
    assert components.texts_of(page(prices)) == ["Travel Card\npurchase Apr: 19.49% to 29.49% variable APR\nannual Fee: $0\nSavings APY\nSavings APY: 4.10%"]
    essential = {"__typename": "AccountProduct", "Title": {"jsonValue": {"value": "Essential"}}, "Description": {"jsonValue": {"value": "Get 25 transactions."}}, "MonthlyFee": {"jsonValue": {"value": 9.75}}, "IncludedTransactions": {"jsonValue": {"value": 25}}}
    assert components.texts_of(page(essential)) == ["Essential\nEssential - Description: Get 25 transactions.\nEssential - Monthly Fee: 9.75\nEssential - Included Transactions: 25"]
    copy = {"title": "Advantage", "content": "<p>$8 monthly fee</p>", "config": {"endpoint": "https://api.bank.example/internal"}, "text": "/content/x"}
    assert components.texts_of(page(copy, "attribute") * 2) == ["Advantage\n$8 monthly fee"]


def test_deep_json_and_odd_values():
    deep = {"title": "Top"}
    for _ in range(400):
        deep = {"below": [deep, 1, None, True]}
    deep["href"] = "/deep"
    assert components.links_of(page(deep)) == [("script", "href", "/deep", "")]
    assert list(components.leaves(None)) == [] and list(components.leaves([1, "a"])) == [] and list(components.leaves({"a": {"value": {"value": None}}})) == []
    assert [(x.path, x.value, x.wrapped) for x in components.leaves({"a": {"value": {"jsonValue": 4}}, "b": [{"c": True, "d": "x"}]})] == [(("a",), 4, True), (("b", "d"), "x", False)]


def test_links_are_resolved_and_told_once(spark):
    html = '<a href="/a/">A</a><a href="/a">A</a><a href="../up?productId=3&utm=x">Up</a><a href="b/c">C</a><a href="//Other.example/x">O</a><a href="?product=1">Q</a><a href="ftp://f/x">F</a><a href="/a">B</a>'
    pages = spark.createDataFrame([(1, "https://www.Bank.example/x/y/z.html?q=1", html), (2, "https://bank.example", '<a href="b">B</a>'), (3, None, html), (4, "https://bank.example/", None), (5, "https://bank.example/", "")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.place, r.source_url, r.label) for r in components.links(pages).collect())
    assert got == [
        (1, 0, "https://www.bank.example/a", "A"), (1, 2, "https://www.bank.example/x/up?productid=3", "Up"), (1, 3, "https://www.bank.example/x/y/b/c", "C"), (1, 4, "https://other.example/x", "O"),
        (1, 5, "https://www.bank.example/x/y/z.html?product=1", "Q"), (1, 7, "https://www.bank.example/a", "B"), (2, 0, "https://bank.example/b", "B"),
    ]


def test_a_worker_holds_the_rows_of_few_texts():
    """Of a full Arrow batch (10,000 rows, 40 MB) little is in Python at a time, and every text's rows come out."""
    import tracemalloc

    import pyarrow as pa
    from quarrystone.operators.batches import each_text

    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["a" * 4000] * 9_999 + [None])], ["k", "t"])
    seen = 0
    tracemalloc.start()
    for out in each_text(Frame(), "k", "t", lambda k, t: [(k, t + "b")], "k long, t string")(iter([batch])):
        assert out.column(0).to_pylist() == list(range(seen, seen := seen + out.num_rows))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 10_000 and out.column(1)[-1].as_py() == "b" and most < 3 << 20


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    from quarrystone.operators.batches import by_bytes

    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 30, "c" * 4, "d" * 4])], ["k", "t"])
    for batch in (b, b.slice(1, 5)):
        parts = list(by_bytes([batch], 1, 10))
        assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 10 or p.num_rows == 1 for p in parts) and len(parts) <= 4


def brute_links(url, html):
    """(url, label) of a page's anchors, card attributes and JSON routes, by regular expressions, recursion and the standard library."""
    out = [(target, " ".join(unescape(re.sub("<[^>]*>", " ", text)).split())) for target, text in re.findall(r'<a href="([^"#][^"]*)">(.*?)</a>', html)]
    out += [(f"/{path}", name) for name, path in re.findall(r'data-cardname="([^"]*)" data-cardurl="/content/[^/]*/([^"]*).html"', html)]

    def down(node, title):
        if isinstance(node, list):
            for x in node:
                down(x, title)
        elif isinstance(node, dict):
            title = node.get("title") or node.get("name") or title
            for k, v in node.items():
                if k in ("targetUrl", "path"):
                    out.append((v, title))
                down(v, title)

    for text in re.findall('<script type="application/json">(.*?)</script>', html):
        down(json.loads(text), "")
    whole = []
    for target, label in out:
        u = urlsplit(urljoin(url, unescape(target)))
        if u.scheme in ("http", "https"):
            path = re.sub("/+", "/", u.path)
            whole.append((f"{u.scheme}://{u.netloc.lower()}{path if path == '/' else path.rstrip('/') or '/'}", label))
    return set(whole)


def test_component_links_of_whole_pages_are_those_of_brute_force(spark):
    from quarrystone.plans import catalogue
    from quarrystone.sources.adapters import read

    pages = read(spark, SF, "component_page").collect()
    got = {}
    for r in catalogue.queries()["component_links"](spark, SF).collect():
        got.setdefault(r.page_id, set()).add((r.source_url.split("?")[0], r.label))
    assert got == {p.page_id: brute_links(p.url, p.html) for p in pages}
    texts = {(r.page_id, r.text) for r in catalogue.queries()["component_texts"](spark, SF).collect()}
    assert texts == {(p.page_id, f"Product {p.page_id}\nCard {p.page_id % 7}\nmonthly Fee: ${p.page_id % 9}") for p in pages}
