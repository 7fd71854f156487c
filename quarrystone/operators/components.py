"""Links and texts of the components that a page is made of: its tags, their data attributes, and JSON in scripts.

One walker reads a page in its order. Nested JSON is walked with the path of keys and the
nearest title above, so a route deep in a component still has the title beside it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators.batches import each_text

# Keys of components, in lower case and without signs.
ROUTES = ("agreementurl", "disclosureurl", "href", "pricingurl", "rateurl", "targeturl", "termsurl", "url")
LABELS = ("content", "label", "title", "name", "headline", "productname", "accountname", "cardname")
TITLES = ("title", "name", "headline", "productname", "accountname", "cardname")
SHOWN = ("body", "content", "description", "headline", "heading", "label", "name", "text", "title", "accountname", "cardname", "productname")
PRICES = (
    "annualfee", "annualpercentagerate", "annualpercentageyield", "apr", "apy", "earlywithdrawalpenalty", "feewaiver", "interestrate", "maintenancefee", "minimumbalance", "minimumdeposit", "minimumopeningdeposit",
    "monthlyfee", "minbalanceforfeewaiver", "includedtransactions", "pertransactionfee", "creditlimit", "loanamount", "openingdeposit", "penalty", "purchaseapr", "purchaseinterestrate", "rate", "ratetype", "term", "termlength",
)
PRICED = ("annual fee", "annual percentage", "apr", "apy", "early withdrawal", "interest rate", "maintenance fee", "minimum balance", "minimum deposit", "monthly fee", "opening deposit", "purchase rate", "rate")
AMOUNTS = ("amount", "displayvalue", "value")
JSON_TYPES = ("application/json", "application/ld+json")
#: Targets that are no pages, and paths that only an editor of the site can open.
NO_PAGES, INTERNAL = ("mailto:", "tel:", "javascript:", "data:", "sms:"), ("/public-sites/", "/sitecore/")


class Leaf(NamedTuple):
    """A scalar of a component: the keys down to it, the title above, its own object, and whether it was wrapped."""

    path: tuple[str, ...]
    title: str
    within: dict
    value: object
    wrapped: bool


class Source(NamedTuple):
    """A part of a page that links or shows something: an anchor, a tag's attributes, or a script."""

    kind: str
    given: object
    text: str


def plain(x: object) -> str:
    """A text without markup, white space collapsed."""
    return " ".join(unescape(re.sub("<[^>]*>", " ", str(x))).split())


def key_of(x: object) -> str:
    return re.sub("[^a-z0-9]", "", str(x).lower())


def spoken(key: str) -> str:
    """A key in words: 'monthlyFee' is 'monthly Fee'."""
    return " ".join(re.sub("([a-z0-9])([A-Z])", r"\1 \2", key).replace("_", " ").replace("-", " ").split())


def scalar(x: object) -> bool:
    return isinstance(x, (str, int, float)) and not isinstance(x, bool)


def unwrapped(x: object) -> object:
    """The scalar in an envelope of ``value`` and ``jsonValue`` objects, or None."""
    for _ in range(6):
        if scalar(x):
            return x
        if not isinstance(x, dict):
            return None
        inner = {key_of(k): v for k, v in x.items()}
        x = inner["jsonvalue"] if "jsonvalue" in inner else inner.get("value")
    return None


def title_of(node: dict, above: str) -> str:
    own = {key_of(k): v for k, v in node.items()}
    return next((t for k in LABELS if (v := unwrapped(own.get(k))) is not None and (t := plain(v))), above)


def leaves(top: object) -> Iterator[Leaf]:
    """All scalars of nested JSON, in its order, without recursion."""
    waiting: list[tuple[object, tuple[str, ...], str, dict | None, bool]] = [(top, (), "", None, False)]
    while waiting:
        node, path, title, within, wrapped = waiting.pop()
        if isinstance(node, dict):
            title = title_of(node, title)
            below = []
            for key, value in node.items():
                inner = unwrapped(value) if isinstance(value, dict) and {key_of(k) for k in value} & {"value", "jsonvalue"} and not {key_of(k) for k in value} & set(LABELS) else None
                below.append((value if inner is None else inner, (*path, str(key)), title, node, inner is not None))
            waiting.extend(reversed(below))
        elif isinstance(node, list):
            waiting.extend((item, path, title, None, False) for item in reversed(node) if isinstance(item, (dict, list)))
        elif scalar(node) and within is not None:
            yield Leaf(path, title, within, node, wrapped)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sources: list[Source] = []
        self.href: str | None = None
        self.parts: list[str] = []
        self.script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        given = {k.lower(): (v or "").strip() for k, v in attrs}
        if any(k.startswith("data-") for k in given):
            self.sources.append(Source("attributes", given, ""))
        if tag == "script":
            self.script = [] if not given.get("src") and given.get("type", "").lower() in JSON_TYPES else None
        elif tag == "a" and given.get("href"):
            self.close_link()
            self.href = given["href"]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.href is not None and data.strip():
            self.parts.append(data.strip())

    def handle_endtag(self, tag):
        if tag == "script":
            if self.script is not None:
                self.sources.append(Source("script", "".join(self.script), ""))
            self.script = None
        elif tag == "a":
            self.close_link()

    def close_link(self):
        if self.href is not None:
            self.sources.append(Source("anchor", self.href, plain(" ".join(self.parts))))
        self.href, self.parts = None, []


def sources_of(html: str) -> list[Source]:
    page = _Page()
    page.feed(html)
    page.close()
    page.close_link()
    return page.sources


def parsed(text: str) -> object:
    """JSON, or None for what is none; only objects and lists are components."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def payloads(source: Source) -> Iterator[tuple[str, object]]:
    """(origin, JSON) of a source."""
    if source.kind == "script":
        yield "script", parsed(source.given)
    elif source.kind == "attributes":
        for name, value in source.given.items():
            if name.startswith("data-"):
                yield name, parsed(value)


def routed(href: str) -> bool:
    """Whether a target is a page that readers can open: no place on the page, no other scheme, no open template, no internal tree."""
    low = href.lower()
    return bool(href) and href[0] != "#" and not low.startswith(NO_PAGES) and "{" not in href and "}" not in href and not urlsplit(low).path.startswith(INTERNAL)


def public_route(href: str) -> str:
    """The route of a page that an attribute names by its place in a content tree: /content/<site>/a/b.html is /a/b."""
    return re.sub(r"^/content/[^/]+(/.*?)(\.html)?$", r"\1", href)


def links_of(html: str) -> list[tuple[str, str, str, str]]:
    """(origin, path, target, label) of the links of a page, in its order."""
    out = []
    for source in sources_of(html):
        if source.kind == "anchor":
            out.append(("anchor", "a", source.given, source.text))
        if source.kind == "attributes":
            titles = [v for k, v in source.given.items() if k.startswith("data-") and re.search("(name|title|label)$", k)]
            out += [("attribute", k, public_route(v), plain(titles[0]) if titles else "") for k, v in source.given.items() if k.startswith("data-") and re.search("(url|href|route)$", k) and re.match("(https?:/)?/", v)]
        for origin, payload in payloads(source):
            for leaf in leaves(payload):
                key = key_of(leaf.path[-1])
                more = key == "path" and len(leaf.path) > 1 and key_of(leaf.path[-2]) == "learnmore"
                alias = key == "url" and any(key_of(k) == "href" for k in leaf.within)  # beside a public route, the other is the editor's
                if (key in ROUTES or more) and isinstance(leaf.value, str) and not alias:
                    out.append((origin, ".".join(leaf.path), leaf.value.strip(), leaf.title))
    return [link for link in out if routed(link[2])]


def texts_of(html: str) -> list[str]:
    """One text for each JSON source of a page that shows any: a line for each text and price, with the title that it belongs to where it stood apart."""
    out = []
    for source in sources_of(html):
        for _, payload in payloads(source):
            lines: dict[str, None] = {}
            for leaf in leaves(payload):
                key, own = key_of(leaf.path[-1]), plain(leaf.value)
                priced = next((t for k, v in leaf.within.items() if key_of(k) in LABELS and isinstance(v, str) and any(m in (t := plain(v)).lower() for m in PRICED)), "")
                titled = f"{leaf.title} - " if leaf.title and leaf.wrapped else ""
                if key in AMOUNTS and priced:
                    line = f"{priced}: {own}"
                elif key in SHOWN:
                    line = own if key in TITLES or not leaf.wrapped else f"{titled}{spoken(leaf.path[-1])}: {own}"
                elif key in PRICES and (leaf.wrapped or isinstance(leaf.value, str)):
                    line = f"{titled}{spoken(leaf.path[-1])}: {own}"
                else:
                    line = own if key == "value" else ""
                if len(own) > 1 and line and not own.startswith(("http://", "https://", "/content/", "/etc/")):
                    lines.setdefault(line)
            if lines:
                out.append("\n".join(lines))
    return list(dict.fromkeys(out))


LINKS = "page_id long, place int, origin string, path string, target string, label string"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, source_url, label, place, origin, path) of ``pages`` (page_id, url, html): each page's links under their normalised URL and label, once.

    Targets are resolved against the page's URL where it has one. A null or empty page has no
    links; a broken component has none; what is no http address in the end is left out.
    """
    found = each_text(pages, "page_id", "html", lambda page_id, html: [(page_id, n, *link) for n, link in enumerate(links_of(html))], LINKS)
    urls = pages.select(F.col("page_id").alias("of_page"), F.col("url").alias("base")).distinct()
    joined = found.join(urls, found["page_id"].eqNullSafe(F.col("of_page")), "left")
    base, target = F.coalesce("base", F.lit("")), F.col("target")
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    whole = (
        F.when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z]+:)", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(target, r"^(\./)+", "")))
    )
    up = r"/(?!\.\./)[^/?#]+/\.\./"
    for _ in range(4):
        whole = F.regexp_replace(whole, up, "/")
    own = joined.select("page_id", "place", "origin", "path", F.col("label"), tx.source_url(whole).alias("source_url")).where("source_url IS NOT NULL")
    first = F.min(F.struct("place", "origin", "path")).alias("first")
    return own.groupBy("page_id", "source_url", "label").agg(first).select("page_id", "source_url", "label", "first.place", "first.origin", "first.path")

