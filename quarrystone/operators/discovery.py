"""Discovery: links of pages, evidence that a page is about a product, contracts of fields, siblings on one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators.quality import first_match

#: An anchor's target, and the first title and heading of a page.
HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"']*)"""
TITLE, HEADING = "(?is)<title[^>]*>(.*?)</title>", "(?is)<h1[^>]*>(.*?)</h1>"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target, kind, internal): each distinct anchor target of a page, and what it is.

    Targets of a page are told apart inside its row, so no shuffle is needed; a null html has none.
    """
    each = pages.select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("target"))
    low = F.lower("target")
    kind = first_match([(F.trim("target") == "", "empty"), (low.startswith("#"), "anchor"), (low.rlike("^(mailto|tel|javascript):"), "excluded"), (F.regexp_replace(low, "[?#].*$", "").endswith(".pdf"), "pdf")], "html")
    relative = ~low.rlike("^[a-z][a-z0-9+.-]*:")
    return each.select("page_id", "target", kind.alias("kind"), (relative | (tx.host(F.col("target")) == tx.host(F.col("url")))).alias("internal"))


def page_evidence(pages: DataFrame, terms: list[str], against: list[str]) -> DataFrame:
    """(page_id, score, reasons): title and first heading count 3, url and body 1; each negative term takes 2, 4 at most; never below 0."""
    any_of = lambda c: F.coalesce(F.lower(c).rlike("|".join(terms)), F.lit(False))
    places = [("title", 3, any_of(F.regexp_extract("html", TITLE, 1))), ("heading", 3, any_of(F.regexp_extract("html", HEADING, 1))), ("url", 1, any_of(F.col("url"))), ("body", 1, any_of(F.col("html")))]
    negative = F.lit(0)
    for word in against:
        negative = negative + F.when(F.lower("html").contains(word), 2).otherwise(0)
    negative = F.least(negative, F.lit(4))
    score = -negative
    for _, points, found in places:
        score = score + F.when(found, points).otherwise(0)
    reasons = F.array_compact(F.array(*[F.when(found, name) for name, _, found in places], F.when(negative > 0, "negative")))
    return pages.select("page_id", F.greatest(F.lit(0), score).alias("score"), reasons.alias("reasons"))


def comparison_contract(df: DataFrame, kind: str, contract: dict[str, dict[str, list[str]]], usable=lambda c: c.isNotNull()) -> DataFrame:
    """``df`` with ``met`` (the first usable field of each requirement), ``missing`` and ``complete``.

    ``contract`` gives, for each value of ``kind``, requirements and the fields that can meet them, best first. A
    kind without a contract has nothing to miss. Everything is decided inside the row.
    """

    def chosen(fields: list[str]) -> Column:
        return F.coalesce(*[F.when(usable(F.col(f)), F.lit(f)) for f in fields])

    none = F.array().cast("array<string>")
    met, missing = none, none
    for value, wanted in contract.items():
        own = [(name, chosen(fields)) for name, fields in wanted.items()]
        met = F.when(F.col(kind) == value, F.array_compact(F.array(*[c for _, c in own]))).otherwise(met)
        missing = F.when(F.col(kind) == value, F.array_compact(F.array(*[F.when(c.isNull(), name) for name, c in own]))).otherwise(missing)
    return df.withColumn("met", met).withColumn("missing", missing).withColumn("complete", F.size("missing") == 0)


def siblings(variants: DataFrame, key: str, order: str, valid: Column, least: int = 2) -> DataFrame:
    """Each valid variant of a key as a row of its own (``sibling``) where a key has ``least`` of them; else the key's first row alone."""
    marked = variants.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    counts = marked.groupBy(F.col(key).alias("_key")).agg(F.count_if("_valid").alias("_n"), F.min(order).alias("_first"))
    both = marked.join(counts, F.col(key) == F.col("_key")).withColumn("sibling", F.col("_n") >= least)
    return both.where((F.col("sibling") & F.col("_valid")) | (~F.col("sibling") & (F.col(order) == F.col("_first")))).drop("_valid", "_key", "_n", "_first")


def drifted(observed: DataFrame) -> DataFrame:
    """(source_id, issue_code, severity, expected_url, detected_url) of sources whose fetch failed, moved, or gave another type."""
    failed, kind, given = F.col("final_url").isNull(), F.col("source_type"), F.lower(F.trim("content_type"))
    fits = F.when(kind == "pdf", given.startswith("application/pdf")).when(kind == "html", given.startswith("text/html")).otherwise(True)
    issue = lambda test, code, severity: F.when(test, F.struct(F.lit(code).alias("issue_code"), F.lit(severity).alias("severity")))
    issues = F.array(issue(failed, "fetch_failed", "error"), issue(~failed & (F.col("final_url") != F.col("expected_url")), "final_url_changed", "warning"), issue(~failed & ~fits, "content_type_changed", "warning"))
    return observed.select("source_id", "expected_url", F.col("final_url").alias("detected_url"), F.inline(F.array_compact(issues))).select("source_id", "issue_code", "severity", "expected_url", "detected_url")


def refresh_differences(drift: DataFrame, unregistered: DataFrame, missing: DataFrame) -> DataFrame:
    """Drift, links to what isn't registered, and sources not found again, as (change_type, severity, source_id, expected_url, detected_url), each once."""
    warned = unregistered.select(F.lit("out_of_registry_link").alias("change_type"), F.lit("warning").alias("severity"), F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("string").alias("expected_url"), "detected_url")
    lost = missing.select(F.lit("source_missing_from_discovery").alias("change_type"), F.lit("warning").alias("severity"), "source_id", "expected_url", F.lit(None).cast("string").alias("detected_url"))
    return drift.withColumnRenamed("issue_code", "change_type").unionByName(warned).unionByName(lost).distinct()


def link_score(fingerprint: Column, weights: dict[str, int], excluded: list[str]) -> Column:
    """The sum of the weights of words that a link's URL and anchor hold; an excluded word decides against it."""
    score = F.lit(0)
    for word, weight in weights.items():
        score = score + F.when(fingerprint.contains(word), weight).otherwise(0)
    return F.when(fingerprint.rlike("|".join(excluded)), -8).otherwise(score)


def combined_score(heuristic: Column, relevance: Column, role: Column) -> Column:
    """Twice the heuristic score, and the model's relevance and role where it gave them."""
    bonus = F.when(role == "detail", 2.0).when(role == "supporting_html", -1.0).when(role == "irrelevant", -3.0).otherwise(0.0)
    return heuristic * 2.0 + F.coalesce(relevance + bonus, F.lit(0.0))
