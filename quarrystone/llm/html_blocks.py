"""HTML to a sequence of text blocks, each with the path of tags above it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

#: Tags that begin and end a block; all others are inline, and <br> is white space.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td textarea tfoot th thead tr ul video audio canvas object".split()
)
#: Tags without content, and those whose content is no text of the page.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "title")
#: A tag that opens ends these, up to the nearest of its stops.
ENDED_BY = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/](?:[^>]*>|[^>]*\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
#: What ends an svg: its end tag, or a tag that HTML has only outside it, unless in a foreignObject.
SVG_END = re.compile(r"<foreignobject(?=[\s/>]).*?</foreignobject\s*>|</svg\s*>|(?=<(?:p|div|h[1-6]|ul|ol|li|dl|table|blockquote|pre|body)[\s/>])", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int


def names_of(attrs: str) -> str:
    """Words of class, id and role, lower-cased, after a dot each."""
    found = [p.lower() for m in NAMED.finditer(attrs) for p in PARTS.findall(m[1] or m[2] or m[3] or "")]
    return "".join(f".{p}" for p in dict.fromkeys(found))


def tokens(page: str) -> Iterator[tuple[re.Match, int]]:
    """Tags and comments, and where the text goes on. An svg goes up to its end, if it isn't closed by itself and has one."""
    at, closed = 0, True
    while m := TOKEN.search(page, at):
        at = m.end()
        if closed and (m["tag"] or "").lower() == "svg" and not m["close"] and m["attrs"][:1] in " \t\n\f\r/" and not m["attrs"].endswith("/"):
            end = next((e.end() for e in SVG_END.finditer(page, at) if e[0][:2] in ("", "</")), None)
            closed = end is not None
            at = end if closed else at
        yield m, at


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. ``path`` holds tag names with their class words; ``linked`` counts characters within links."""
    out: list[Block] = []
    path: list[str] = []
    tags: list[str] = []
    parts: list[str] = []
    linked, in_link, upto = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, tuple(path), min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    for m, then in tokens(page):
        add(page[upto : m.start()])
        upto = then
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 0 if m["close"] else 1
        elif tag in BLOCK_TAGS:
            end_block()
            if m["close"]:
                if tag in tags:
                    at = len(tags) - 1 - tags[::-1].index(tag)
                    del tags[at:], path[at:]
            elif tag not in VOID_TAGS:
                # a block tag ends an open paragraph; items and cells end their like
                stops = ENDED_BY.get(tag, ())
                ends = "p" if "p" in tags else tag if tag in ENDED_BY else ""
                if tag in ("td", "th", "dt", "dd"):
                    ends = next((t for t in reversed(tags) if t in ("td", "th", "dt", "dd") or t in stops), ends)
                if ends and ends in tags and ends not in stops:
                    at = len(tags) - 1 - tags[::-1].index(ends)
                    if ends == "p" or not any(t in stops for t in tags[at:]):
                        del tags[at:], path[at:]
                tags.append(tag)
                path.append(tag + names_of(m["attrs"]) if m["attrs"] else tag)
    add(page[upto:])
    end_block()
    return out
