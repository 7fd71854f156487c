"""HTML pages as sections under their headings, and the chunks of those with their places in the whole text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators import components
from quarrystone.operators.batches import by_bytes, each_text
from quarrystone.operators.evidence import CHUNK, OVERLAP, split_text

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LINES = {"p", "li", "td", "th"}
#: Counted as lines only where nothing of either kind is inside.
LEAVES = {"div", "span", "dt", "dd", "strong"}
DROPPED = {"script", "style", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.parts = tag, parent, []

    def text(self) -> str:
        """All text below, white space collapsed; walked without recursion, since pages nest deeply."""
        out, waiting = [], [self]
        while waiting:
            at = waiting.pop()
            if isinstance(at, str):
                out.append(at)
            else:
                waiting.extend(reversed(at.parts))
        return " ".join(" ".join(out).split())

    def below(self) -> Iterator[_Node]:
        """All nodes below, in the order of the page."""
        waiting = [p for p in reversed(self.parts) if not isinstance(p, str)]
        while waiting:
            at = waiting.pop()
            yield at
            waiting.extend(p for p in reversed(at.parts) if not isinstance(p, str))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None)
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        elif not self.dropped:
            if tag == "img":
                alt = " ".join((dict(attrs).get("alt") or "").split())
                above, tags = self.at, set()
                while above:
                    tags.add(above.tag)
                    above = above.parent
                if alt.casefold() in ("check", "x") and "table" in tags:
                    self.at.parts.append(alt)
            elif tag not in VOID:
                node = _Node(tag, self.at)
                self.at.parts.append(node)
                self.at = node

    def handle_startendtag(self, tag, attrs):
        if tag == "img":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
            return
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:  # an end without its start closes nothing
            self.at = at.parent

    def handle_data(self, data):
        if not self.dropped and data.strip():
            self.at.parts.append(data)


def _lines(top: _Node) -> list[tuple[str, str]]:
    """(heading, text) of each section: a heading opens one, lines that repeat the one before are skipped."""
    out: list[tuple[str, str]] = []
    title, lines, last = "", [], None
    kept = HEADINGS | LINES | LEAVES
    holders = set()
    for node in top.below():
        if node.tag in kept:
            above = node.parent
            while above is not None and id(above) not in holders:
                holders.add(id(above))
                above = above.parent

    def flush() -> None:
        if title or lines:
            out.append((title or "Document", "\n".join([title or "Document", *lines])))

    for node in top.below():
        if node.tag not in kept or (node.tag in LEAVES and id(node) in holders):
            continue
        text = node.text()
        if not text or (node.tag not in HEADINGS and text == last):
            continue
        if node.tag in HEADINGS:
            flush()
            title, lines = text, []
        else:
            lines.append(text)
        last = text
    flush()
    return out


def sections_of(html: str) -> list[tuple[str, str]]:
    """(heading, text) of a page's sections, from its main part, else its body, else all of it; a page without lines is one section."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    first = lambda tag: next((n for n in tree.root.below() if n.tag == tag), None)
    for top in (first("main"), first("body"), tree.root):
        if top is not None:
            if found := _lines(top):
                return found
            if text := top.text():
                return [("document", text)]
    return []


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-") or "section"


SECTIONS = "page_id long, section_index int, anchor string, text string, start int, stop int"


def rows_of(key: object, html: str) -> list[tuple]:
    """(key, section_index, anchor, text, start, stop) of a page's sections."""
    out, at = [], 0
    own = [(slug(heading), text) for heading, text in sections_of(html)] + [(f"structured-component-{k}", text) for k, text in enumerate(components.texts_of(html), 1)]
    for k, (anchor, text) in enumerate(own):
        out.append((key, k, anchor, text, at, at + len(text)))
        at += len(text) + 2
    return out


def sections(pages: DataFrame) -> DataFrame:
    """(page_id, section_index, anchor, text, start, stop) of every page; places count in the sections' texts joined by an empty line.
    Texts of structured data follow the sections.

    A tree of tags is beyond SQL, so Python reads each page; pages stay where they are. A null
    or empty page has no sections.
    """

    return each_text(pages, "page_id", "html", rows_of, SECTIONS)


def section_chunks(parts: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of sections with their number in the page, places in the whole text, and an id made of both."""

    schema = "page_id long, section_index int, anchor string, start int, stop int, chunk string, section_start int, section_stop int"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 3):
            rows = [(p, k, a, s + i, s + j, t[i:j], s, e) for p, k, a, t, s, e in zip(*(b.column(n).to_pylist() for n in range(6)), strict=True) for i, j in split_text(t, size, overlap)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)

    cut = parts.select("page_id", "section_index", "anchor", "text", "start", "stop").mapInArrow(of, schema)
    numbered = cut.withColumn("chunk_index", F.row_number().over(Window.partitionBy("page_id").orderBy("section_index", "start")) - 1)
    metadata = F.to_json(F.struct(F.lit("html-sections-1").alias("parser_version"), F.length("chunk").alias("chunk_length"), F.col("section_start").alias("segment_char_start"), F.col("section_stop").alias("segment_char_end")))
    return numbered.select("page_id", "chunk_index", "anchor", "start", "stop", "chunk", tx.short_id("chunk", F.col("page_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), metadata.alias("metadata"))


def of_kind(files: DataFrame) -> DataFrame:
    """``files`` (content_type, body) with ``kind``: html by its type, pdf by its type or first bytes, else unknown."""
    named = F.lower(F.trim("content_type"))
    magic = F.substring(F.col("body"), 1, 4) == F.lit(b"%PDF")
    return files.withColumn("kind", F.when(named.startswith("text/html"), "html").when(named.startswith("application/pdf") | F.coalesce(magic, F.lit(False)), "pdf").otherwise("unknown"))
