"""Discovery of registered sources: a frontier of pages that grows by their links until it grows no more.

Each round joins the links of the pages found last with the registry, on URL and type. What
is new is written and read again, so a round's plan doesn't hold the rounds before it. Pages
are followed to ``DEPTH`` links from an entry; what lies further is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators.lineage import kept
from quarrystone.operators.quality import first_match

DEPTH = 3
# Parts of a host or path that mark a link as none to follow, in order.
EXCLUDED = (
    ("personalized_discovery_link", ("find-the-account", "recommend")),
    ("compare_flow_link", ("compare",)),
    ("promotion_link", ("offer", "bonus", "promo")),
    ("authenticated_flow_link", ("easyweb", "login", "secureopen", "secure-open", "open-account", "apply")),
)
#: Types of sources whose links are followed.
FOLLOWED = ("html",)


def source_type(url: Column) -> Column:
    return F.when(F.regexp_replace(F.lower(url), "[?#].*$", "").endswith(".pdf"), "pdf").otherwise("html")


def warning(url: Column, domains: list[str]) -> Column:
    """Why a link isn't followed, or null: words of its host and path, or a host outside ``domains``."""
    print_ = F.regexp_extract(F.lower(url), "^[a-z]+://([^?#]*)", 1)
    rules = [(print_.rlike("|".join(words)), code) for code, words in EXCLUDED]
    inside = F.lit(False)
    for d in domains:
        inside = inside | tx.in_domain(url, d)
    return first_match([*rules, (~inside, "cross_domain_link")] if domains else rules)


def discover(links: DataFrame, registry: DataFrame, domains: list[str] | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(sources, warnings) from ``links`` (from_url, target_url) and ``registry`` (source_id, url, source_type, role).

    Sources are all rows of the registry with status (selected for an entry, discovered, or
    seed_only), depth and discovered_on: the least page, of those with the least depth, that
    links there. Warnings are (discovered_on, code, target_url), once each: links that are not
    followed, and links to what isn't registered. URLs are expected normalised.
    """
    told = links.where("target_url IS NOT NULL").select("from_url", "target_url", source_type(F.col("target_url")).alias("type"), warning(F.col("target_url"), domains or []).alias("code")).distinct()
    told = kept(told, "links")
    known = registry.select("source_id", F.col("url").alias("target_url"), F.col("source_type").alias("type"))
    entries = registry.where("role = 'entry'").select("source_id", "url", "source_type", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("discovered_on"))
    found = frontier = kept(entries, "frontier")
    for step in range(1, depth + 1):
        pages = frontier.where(F.col("source_type").isin(*FOLLOWED)).select(F.col("url").alias("from_url")).distinct()
        out = told.where("code IS NULL").join(pages, "from_url", "left_semi").join(known, ["target_url", "type"])
        new = out.groupBy("source_id", F.col("target_url").alias("url"), F.col("type").alias("source_type")).agg(F.min("from_url").alias("discovered_on"))
        new = new.join(found.select("source_id"), "source_id", "left_anti").select("source_id", "url", "source_type", F.lit(step).alias("depth"), "discovered_on")
        frontier = kept(new, "frontier")
        if frontier.limit(1).count() == 0:
            break
        found = found.unionByName(frontier)
    status = F.when(F.col("depth") == 0, "selected").when(F.col("depth") > 0, "discovered").otherwise("seed_only")
    sources = registry.select("source_id", "url").join(found.select("source_id", "depth", "discovered_on"), "source_id", "left").withColumn("status", status)
    followed = found.where(F.col("source_type").isin(*FOLLOWED) & (F.col("depth") < depth)).select(F.col("url").alias("from_url")).distinct()
    seen = told.join(followed, "from_url", "left_semi")
    unknown = seen.where("code IS NULL").join(known, ["target_url", "type"], "left_anti").withColumn("code", F.lit("out_of_registry_link"))
    warnings = seen.where("code IS NOT NULL").unionByName(unknown).select(F.col("from_url").alias("discovered_on"), "code", "target_url").distinct()
    return sources, warnings
