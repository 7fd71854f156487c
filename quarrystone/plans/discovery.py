"""Links and evidence of pages, comparison contracts, sibling products."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import discovery
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query(r"""
WITH t AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)', 1)) AS target FROM pages)
SELECT page_id, target, CASE WHEN trim(target) = '' THEN 'empty' WHEN target LIKE '#%' THEN 'anchor' WHEN regexp_matches(lower(target), '^(mailto|tel|javascript):') THEN 'excluded'
    WHEN regexp_replace(lower(target), '[?#].*$', '') LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS kind,
  NOT regexp_matches(lower(target), '^[a-z][a-z0-9+.-]*:') OR regexp_replace(lower(regexp_extract(target, '://([^/:?#]*)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '^www\.', '') AS internal FROM t""")  # fmt: skip
def page_links(spark, sf_dir):
    """Every anchor target of every page, classified."""
    return discovery.links(read(spark, sf_dir, "pages"))


@query(r"""
WITH f AS (SELECT page_id, regexp_matches(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 'er|in') AS t, regexp_matches(lower(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), 'er|in') AS h,
  regexp_matches(lower(url), 'er|in') AS u, regexp_matches(lower(html), 'er|in') AS b, least(4, 2 * CAST(contains(lower(html), 'cookie') AS INTEGER) + 2 * CAST(contains(lower(html), 'login') AS INTEGER) + 2 * CAST(contains(lower(html), 'newsletter') AS INTEGER)) AS n FROM pages)
SELECT page_id, greatest(0, CAST(t AS INTEGER) * 3 + CAST(h AS INTEGER) * 3 + CAST(u AS INTEGER) + CAST(b AS INTEGER) - n) AS score,
  concat_ws(',', CASE WHEN t THEN 'title' END, CASE WHEN h THEN 'heading' END, CASE WHEN u THEN 'url' END, CASE WHEN b THEN 'body' END, CASE WHEN n > 0 THEN 'negative' END) AS reasons FROM f""")  # fmt: skip
def page_evidence_scores(spark, sf_dir):
    """How much speaks for a page being about the terms asked for."""
    return discovery.page_evidence(read(spark, sf_dir, "pages"), ["er", "in"], ["cookie", "login", "newsletter"]).select("page_id", "score", F.array_join("reasons", ",").alias("reasons"))


#: Requirements of a comparison by product type: what can meet each, best first.
CONTRACT = {
    "savings": {"rate": ["direct_rate", "posted_rate"], "balance": ["minimum_balance", "minimum_deposit"]},
    "gic": {"rate": ["direct_rate", "posted_rate"], "deposit": ["minimum_deposit"], "term": ["term_length_days"]},
    "chequing": {"fee": ["display_fee", "monthly_fee"]},
    "mortgage": {"rate": ["posted_rate", "direct_rate"]},
}


@query(sql("""
WITH m AS (SELECT product_id, product_type, CASE WHEN direct_rate IS NOT NULL THEN 'direct_rate' WHEN posted_rate IS NOT NULL THEN 'posted_rate' END AS r, CASE WHEN posted_rate IS NOT NULL THEN 'posted_rate' WHEN direct_rate IS NOT NULL THEN 'direct_rate' END AS p,
  CASE WHEN minimum_balance IS NOT NULL THEN 'minimum_balance' WHEN minimum_deposit IS NOT NULL THEN 'minimum_deposit' END AS b, CASE WHEN minimum_deposit IS NOT NULL THEN 'minimum_deposit' END AS d,
  CASE WHEN term_length_days IS NOT NULL THEN 'term_length_days' END AS t, CASE WHEN display_fee IS NOT NULL THEN 'display_fee' WHEN monthly_fee IS NOT NULL THEN 'monthly_fee' END AS f FROM product),
c AS (SELECT product_id, CASE product_type WHEN 'savings' THEN concat_ws(',', r, b) WHEN 'gic' THEN concat_ws(',', r, d, t) WHEN 'chequing' THEN concat_ws(',', f) WHEN 'mortgage' THEN concat_ws(',', p) ELSE '' END AS met,
  CASE product_type WHEN 'savings' THEN concat_ws(',', CASE WHEN r IS NULL THEN 'rate' END, CASE WHEN b IS NULL THEN 'balance' END) WHEN 'gic' THEN concat_ws(',', CASE WHEN r IS NULL THEN 'rate' END, CASE WHEN d IS NULL THEN 'deposit' END, CASE WHEN t IS NULL THEN 'term' END)
    WHEN 'chequing' THEN concat_ws(',', CASE WHEN f IS NULL THEN 'fee' END) WHEN 'mortgage' THEN concat_ws(',', CASE WHEN p IS NULL THEN 'rate' END) ELSE '' END AS missing FROM m)
SELECT product_id, met, missing, missing = '' AS complete FROM c""", "product"))  # fmt: skip
def comparison_quality(spark, sf_dir):
    """Whether a product has what a comparison of its type needs."""
    found = discovery.comparison_contract(read(spark, sf_dir, "product"), "product_type", CONTRACT)
    return found.select("product_id", F.array_join("met", ",").alias("met"), F.array_join("missing", ",").alias("missing"), "complete")


@query(sql("""
WITH n AS (SELECT product_id, count(*) FILTER (WHERE rate_value > 45) AS n, min(version_no) AS first_no FROM version GROUP BY 1)
SELECT product_id, CAST(version_no AS BIGINT) AS version_no, rate_value, n >= 2 AS sibling FROM version JOIN n USING (product_id) WHERE (n >= 2 AND rate_value > 45) OR (n < 2 AND version_no = first_no)""", "version"))  # fmt: skip
def sibling_products(spark, sf_dir):
    """Two or more valid variants of a product become candidates of their own."""
    rows = discovery.siblings(read(spark, sf_dir, "version"), "product_id", "version_no", F.col("rate_value") > 45)
    return rows.select("product_id", F.col("version_no").cast("bigint").alias("version_no"), "rate_value", "sibling")
