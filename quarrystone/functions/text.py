"""Expressions over names, URLs, rates, dates and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that tell pages apart; all others are left out of a normalised URL.
IDENTITY_KEYS = ("id", "page", "product")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def name_key(x: Column) -> Column:
    """A product's name without case, signs, and a closing 'account'."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " account$", "")


def identity(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def human(x: Column) -> Column:
    return F.initcap(F.translate(x, "_-", "  "))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1))


def short_id(prefix: str, *parts: Column) -> Column:
    """A deterministic id: the first 16 hex digits of a digest of the parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def number(x: Column) -> Column:
    """The number in a text like '4.49%' or '1,200.50', or null."""
    return F.regexp_replace(F.trim(x), "[%,$ ]", "").try_cast("double")


def fee(x: Column) -> Column:
    """A fee in words or digits: 'no fee' and the like are zero."""
    return F.when(F.lower(x).rlike("no (monthly |annual )?fee|free"), F.lit(0.0)).otherwise(number(x))


def promotional_rate(x: Column) -> Column:
    """The rate of an offer that holds for some months or days, as a total."""
    return F.nullif(F.regexp_extract(F.lower(x), r"([0-9]+(?:\.[0-9]+)?)\s*% (?:for|during) (?:the first )?[0-9]+ (?:months|days)", 1), F.lit("")).try_cast("double")


def day(x: Column) -> Column:
    """A date from any of the usual forms."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy")])


def term_days(x: Column) -> Column:
    """Days of '90 days', '6 months' (30 each) or '1.5 years' (365 each), half a day up."""
    n = F.nullif(F.regexp_extract(F.lower(x), r"([0-9]+(?:\.[0-9]+)?)\s*-?\s*(?:day|month|year)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(F.lower(x), r"[0-9]\s*-?\s*(day|month|year)", 1)
    return F.floor(n * F.when(unit == "day", 1).when(unit == "month", 30).otherwise(365) + 0.5).cast("int")


def url(x: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment or closing slash, identity keys alone and in order."""
    bare = F.regexp_replace(F.trim(x), "#.*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    head = F.regexp_replace(F.regexp_replace(F.lower(head), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/{2,}", "/"), "/$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: F.substring_index(p, "=", 1).isin(*IDENTITY_KEYS)))
    return F.concat(head, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


# Query keys that tell sources apart, on any path and on paths of disclosures.
SOURCE_KEYS = ("accountid", "accounttype", "agreementid", "cardid", "disclosureid", "documentid", "market", "product", "productcode", "productid", "region", "state", "zip", "zipcode")
DISCLOSURE_KEYS, DISCLOSURE_PATHS = ("cid", "offerid", "pocd"), ("agreement", "disclosure", "fee", "pdf", "pricing", "rate", "terms")


def source_url(x: Column) -> Column:
    """The URL that names a source: scheme and host in lower case, no default port, the path without doubled or closing slashes, identity keys alone and in order; null unless http or https."""
    bare = F.regexp_replace(F.trim(x), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z]+://[^/?]+)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[a-zA-Z]+://[^/?]+([^?]*)", 1), "/{2,}", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))
    low = F.lower(path)
    disclosure = low.contains(DISCLOSURE_PATHS[0])
    for mark in DISCLOSURE_PATHS[1:]:
        disclosure = disclosure | low.contains(mark)
    pairs = F.transform(F.split(F.regexp_extract(bare, r"[?](.*)$", 1), "&"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & (p["k"].isin(*SOURCE_KEYS) | disclosure & p["k"].isin(*DISCLOSURE_KEYS))))
    query = F.array_join(F.transform(kept, lambda p: F.concat_ws("=", p["k"], p["v"])), "&")
    return F.when(head.rlike("^https?://"), F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), query)).otherwise("")))


def official_domain(x: Column) -> Column:
    """The domain of an official site, or null for what is none: an address in numbers, localhost, a name without a dot."""
    name = F.regexp_replace(F.lower(F.regexp_extract(F.trim(x), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#]*)", 1)), r"^\.+|\.+$", "")
    name = F.regexp_replace(name, r"^www\.", "")
    return F.when(name.contains(".") & ~name.rlike(r"^[0-9.]+$") & (name != "localhost"), name)


LANGUAGES = ("en", "fr", "es", "de", "it", "pt", "zh", "ja", "ko")


def locale_conflict(x: Column, language: str) -> Column:
    """Whether a URL's first host label, or one of its first three path segments, names another language."""
    label = F.regexp_extract(F.lower(x), r"://([^./:?#]*)", 1)
    label = F.when(label == "zt", "zh").otherwise(label)
    segments = F.slice(F.filter(F.split(F.regexp_extract(F.lower(x), r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != ""), 1, 3)
    named = F.filter(F.transform(segments, lambda s: F.substring_index(F.translate(s, "_", "-"), "-", 1)), lambda s: s.isin(*LANGUAGES))
    return (label.isin(*LANGUAGES) & (label != language)) | F.coalesce(F.get(named, F.lit(0)) != language, F.lit(False))


def market_conflict(x: Column, country: str) -> Column:
    """Whether a URL's host or path names markets, and not the one asked for."""
    name = F.lower(F.regexp_extract(x, r"://([^/:?#]*)", 1))
    segments = F.slice(F.filter(F.split(F.regexp_extract(F.lower(x), r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != ""), 1, 3)
    found = lambda c: F.substring_index(name, ".", 1).isin(c) | name.endswith(f".{c}") | F.exists(segments, lambda s: F.translate(s, "_", "-").rlike(f"^([a-z]{{2}}-)?{c}$"))
    other = {"ca": "us", "us": "ca"}[country]
    return found(other) & ~found(country)


def host(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(x, r"://([^/:?#]*)", 1)), r"^www\.", "")


def in_domain(x: Column, domain: str) -> Column:
    return (host(x) == domain) | host(x).endswith(f".{domain}")


def around(x: Column, at: Column, before: int, after: int) -> Column:
    """The text around a place, cut to the text's ends."""
    start = F.greatest(at - before, F.lit(1))
    return x.substr(start, at + after - start)
