"""Sections of pages by heading, and the chunks of those."""

import pytest

from quarrystone.operators import components, sections

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><p>menu</p></nav><main><div>Lead <b>in</b></div>
<h1>Rates &amp; fees</h1><p>One  two</p><p>One two</p><ul><li>Item</li></ul><div><span>Leaf</span><span>4.5%</span></div><script>var t="</p>";</script>
<h2></h2><h3>Table</h3><table><tr><th>Free</th><td><img alt="Check"></td><td><img alt=" X "/></td><td><img alt="photo"></td></tr></table><svg><p>icon</p></svg><noscript><p>no</p></noscript></main><p>after</p></body></html>"""


def test_sections_by_heading():
    assert sections.sections_of(PAGE) == [("Document", "Document\nLead in"), ("Rates & fees", "Rates & fees\nOne two\nItem\nLeaf\n4.5%"), ("Table", "Table\nFree\nCheck\nX")]


@pytest.mark.parametrize("html, want", [("", []), ("<main></main><body><p>b</p></body>", [("Document", "Document\nb")]), ("just words", [("document", "just words")]), ("<h1>Only</h1>", [("Only", "Only")]), ("<p>a</i></b>b", [("Document", "Document\nab")]), ("<div>" * 3000 + "deep", [("Document", "Document\ndeep")])])
def test_odd_pages(html, want):
    got = sections.sections_of(html)
    assert got == want or [(h, t.replace(" ", "")) for h, t in got] == want


def test_structured_texts():
    html = """<script type="application/ld+json">{"@type": "Product", "name": "Card &amp; more", "offers": [{"description": "<b>No</b> fee", "price": 3}, {"value": 4.5}], "url": "x"}</script>
<div data-props='{"title": "Rate", "nested": {"text": "5%", "flag": true}}' data-id="7"></div><script type="application/json">{broken</script><script>var a = {"name": "no"};</script><script type="text/json">[]</script>"""
    assert components.texts_of(html) == ["Card & more\nNo fee\n4.5", "Rate\n5%"] and components.texts_of("") == []


def test_sections_and_chunks_of_a_table(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<h1>Long</h1><p>" + "word " * 600 + "</p>"), (4, "<p>x</p>")], "page_id long, html string")
    parts = sections.sections(pages)
    rows = parts.where("page_id = 1").orderBy("section_index").collect()
    whole = "\n\n".join(r.text for r in rows)
    assert [r.anchor for r in rows] == ["document", "rates-fees", "table"] and all(whole[r.start : r.stop] == r.text for r in rows)
    chunks = sections.section_chunks(parts).collect()
    assert {c.page_id for c in chunks} == {1, 4} and all(whole[c.start : c.stop] == c.chunk for c in chunks if c.page_id == 1)
    assert sorted(c.chunk_index for c in chunks if c.page_id == 4) == list(range(sum(c.page_id == 4 for c in chunks))) and all(len(c.chunk) <= 900 for c in chunks)
    assert len({c.chunk_id for c in chunks}) == len(chunks) and sections.sections(pages.limit(0)).count() == 0


def test_kinds_of_files(spark):
    files = spark.createDataFrame([(1, "text/html; charset=x", b"<p>"), (2, "application/PDF", b""), (3, "application/octet-stream", b"%PDF-1.7"), (4, "image/png", None)], "id int, content_type string, body binary")
    assert {r.id: r.kind for r in sections.of_kind(files).collect()} == {1: "html", 2: "pdf", 3: "pdf", 4: "unknown"}
