r"""Discovery of registered sources, pages of several products, and parsing that is done once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrystone.operators import frontier, increments, lineage, sections, variants
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

DOMAINS = ["bank.example"]
_PRINT = "regexp_extract(lower(target_url), '^[a-z]+://([^?#]*)', 1)"
_CODES = " ".join(f"WHEN regexp_matches({_PRINT}, '{'|'.join(words)}') THEN '{code}'" for code, words in frontier.EXCLUDED)
_FOUND = rf"""
WITH l AS (SELECT DISTINCT from_url, target_url, CASE WHEN regexp_replace(lower(target_url), '[?#].*$', '') LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS type,
  CASE {_CODES} WHEN NOT regexp_matches(lower(target_url), '^https?://([^/]*\.)?bank\.example(/|$)') THEN 'cross_domain_link' END AS code FROM site_link WHERE target_url IS NOT NULL),
walk AS (SELECT source_id, url, source_type, 0 AS depth, CAST(NULL AS VARCHAR) AS discovered_on FROM registered WHERE role = 'entry'
  UNION SELECT r.source_id, r.url, r.source_type, depth + 1, walk.url FROM walk JOIN l ON l.from_url = walk.url AND walk.source_type = 'html' AND code IS NULL JOIN registered r ON r.url = l.target_url AND r.source_type = l.type WHERE depth < {frontier.DEPTH}),
found AS (SELECT source_id, any_value(url) AS url, any_value(source_type) AS source_type, min(depth) AS depth FROM walk GROUP BY 1)
"""


def _recursive(text: str) -> str:
    return "WITH RECURSIVE " + sql(text, "site_link", "registered")[5:]


def _discovered(spark, sf_dir):
    return frontier.discover(read(spark, sf_dir, "site_link"), read(spark, sf_dir, "registered"), DOMAINS)


@query(_recursive(_FOUND + "SELECT source_id, depth, CASE WHEN depth > 0 THEN (SELECT min(discovered_on) FROM walk WHERE walk.source_id = registered.source_id AND walk.depth = found.depth) END AS discovered_on, CASE WHEN depth = 0 THEN 'selected' WHEN depth > 0 THEN 'discovered' ELSE 'seed_only' END AS status FROM registered LEFT JOIN found USING (source_id)"))
def discovered_sources(spark, sf_dir):
    """All registered sources, with how far from an entry links lead to them, if they do."""
    return _discovered(spark, sf_dir)[0].select("source_id", "depth", "discovered_on", "status")


@query(_recursive(_FOUND + f", seen AS (SELECT l.* FROM l JOIN found ON found.url = l.from_url AND found.source_type = 'html' AND found.depth < {frontier.DEPTH}) SELECT DISTINCT from_url AS discovered_on, coalesce(code, 'out_of_registry_link') AS code, target_url FROM seen WHERE code IS NOT NULL OR NOT EXISTS (SELECT 1 FROM registered r WHERE r.url = target_url AND r.source_type = type)"))
def discovery_warnings(spark, sf_dir):
    """Links of the pages found that aren't followed, and links to what isn't registered."""
    return _discovered(spark, sf_dir)[1]


@query(sql(r"""
WITH s AS (SELECT page_id, product_type, n AS section_index, string_split_regex(t, '</?[a-z0-9]+>') AS parts FROM (SELECT page_id, product_type, unnest(string_split_regex(regexp_extract(html, '<main>(.*)</main>', 1), '<h[123]>')) AS t, generate_subscripts(string_split_regex(regexp_extract(html, '<main>(.*)</main>', 1), '<h[123]>'), 1) - 2 AS n FROM listing) WHERE t <> ''),
l AS (SELECT page_id, product_type, section_index, parts[1] AS name, [x for x in parts[2:] if x <> ''] AS lines FROM s),
f AS (SELECT *, [x for x in lines if contains(lower(x), 'annual fee') AND regexp_matches(x, '\$ ?[0-9]')][1] AS fee, [x for x in lines if regexp_matches(lower(x), 'purchase rate|purchase interest|purchases|purchase apr') AND regexp_matches(x, '[0-9] ?%')][1] AS rate,
  [x for x in lines if regexp_matches(lower(x), 'rate|prime')][1] AS summary, [x for x in lines if contains(lower(x), 'limit')][1] AS lim, [x for x in lines if regexp_matches(lower(x), 'minimum payment|interest only|interest-only')][1] AS pay, [x for x in lines if regexp_matches(lower(x), 'secured|unsecured|equity|collateral')][1] AS sec FROM l),
v AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY section_index) AS k FROM f WHERE lower(name) NOT IN ('overview', 'document') AND ((product_type = 'credit-card' AND fee IS NOT NULL AND rate IS NOT NULL) OR (product_type = 'line-of-credit' AND summary IS NOT NULL AND lim IS NOT NULL AND pay IS NOT NULL AND sec IS NOT NULL))),
n AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n_variants FROM v WHERE k = 1)
SELECT page_id, 'grounded-' || product_type || '-' || substr(sha256(lower(name)), 1, 16) AS candidate_key, name AS product_name, CAST(section_index AS INTEGER) AS section_index, CAST(n_variants AS BIGINT) AS n_variants,
  CASE product_type WHEN 'credit-card' THEN regexp_extract(fee, '\$ ?([0-9]+)', 1) || '|' || regexp_extract(rate, '([0-9.]+) ?%', 1) ELSE summary || '|' || lim || '|' || pay || '|' || sec END AS values FROM n WHERE n_variants >= 2""", "listing"))  # fmt: skip
def page_variants(spark, sf_dir):
    """Products that one page shows side by side, each with the values that its own part grounds."""
    pages = read(spark, sf_dir, "listing")
    found = variants.variants(sections.sections(pages), pages.select("page_id", "product_type"))
    return found.select("page_id", "candidate_key", "product_name", "section_index", "n_variants", F.array_join(F.map_values("fields"), "|").alias("values"))


@query("""
SELECT page_id, sha256(coalesce(html, '')) AS snapshot_id, CASE WHEN sha256(coalesce(html, '')) IN (SELECT sha256(coalesce(html, '')) FROM pages WHERE page_id % 3 = 0) THEN 'reused' ELSE 'stored' END AS again, 'reused' AS repeated, 'stored' AS other_version FROM pages""")
def parse_actions(spark, sf_dir):
    """What runs of the parser do with each page: after a first run over a third of them, over all, over all again, and by another version."""
    store = f"{lineage.shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages")
    increments.parse(pages.where("page_id % 3 = 0"), store, "html-1")
    runs = [increments.parse(pages, store, version).withColumnRenamed("action", name) for name, version in (("again", "html-1"), ("repeated", "html-1"), ("other_version", "html-2"))]
    return runs[0].join(runs[1].drop("snapshot_id"), "page_id").join(runs[2].drop("snapshot_id"), "page_id")
