"""Sections and chunks of pages, source URLs and domains, duplicates of details, drift of the registry and what a refresh finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators import components, discovery, sections
from quarrystone.operators.batches import each_text
from quarrystone.operators.picks import latest_per_key
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query()
def page_sections(spark, sf_dir):
    """Every page under its headings; a tree of tags is beyond SQL, tests hold it against pages made by hand."""
    return sections.sections(read(spark, sf_dir, "pages")).select("page_id", "section_index", "anchor", "start", "stop", F.sha2("text", 256).alias("text_id"))


@query()
def section_chunks(spark, sf_dir):
    """Chunks of the sections with ids and metadata."""
    return sections.section_chunks(sections.sections(read(spark, sf_dir, "pages"))).select("page_id", "chunk_index", "anchor", "start", "stop", "chunk_id", "metadata")


@query()
def component_links(spark, sf_dir):
    """Links of pages and of their components, each under its URL and the title beside it; tests hold it against brute force."""
    return components.links(read(spark, sf_dir, "component_page"))


@query()
def component_texts(spark, sf_dir):
    """What components of pages show, one text for each."""
    rows = lambda page_id, html: [(page_id, n, text) for n, text in enumerate(components.texts_of(html))]
    return each_text(read(spark, sf_dir, "component_page"), "page_id", "html", rows, "page_id long, n int, text string")


#: The URLs of pages as links would give them: other case, ports, doubled slashes, parameters of sources and of campaigns.
LINKED = "CASE page_id % 6 WHEN 0 THEN concat(url, '#top') WHEN 1 THEN concat(replace(url, 'https://', 'HTTPS://'), '//rates/') WHEN 2 THEN concat('https://Bank.Example.com:443/fees/?zip=9&CID=7&utm=x&productId=', CAST(page_id AS {0})) WHEN 3 THEN concat('http://10.0.0.', CAST(page_id % 9 AS {0}), '/ca/page?cid=1&state=') WHEN 4 THEN concat('ftp://files.example.com/', CAST(page_id AS {0})) ELSE 'https://www.fr.example.ca/us-x/fr_ca/us' END"
_KEYS = "', '".join(tx.SOURCE_KEYS)


@query(rf"""
WITH u AS (SELECT page_id, {LINKED.format('VARCHAR')} AS link FROM pages), b AS (SELECT page_id, regexp_replace(trim(link), '#.*$', '') AS bare FROM u),
p AS (SELECT page_id, bare, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([a-zA-Z]+://[^/?]+)', 1)), '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') AS head, regexp_replace(regexp_extract(bare, '^[a-zA-Z]+://[^/?]+([^?]*)', 1), '/{{2,}}', '/', 'g') AS raw FROM b),
t AS (SELECT *, CASE WHEN raw IN ('', '/') THEN '/' ELSE regexp_replace(raw, '/$', '') END AS path FROM p),
k AS (SELECT page_id, string_agg(k || '=' || v, '&' ORDER BY k, v) AS kept FROM (SELECT page_id, path, lower(trim(split_part(x, '=', 1))) AS k, trim(regexp_extract(x, '=(.*)$', 1)) AS v FROM (SELECT page_id, path, unnest(string_split(regexp_extract(bare, '[?](.*)$', 1), '&')) AS x FROM t))
  WHERE v <> '' AND (k IN ('{_KEYS}') OR k IN ('cid', 'offerid', 'pocd') AND regexp_matches(lower(path), 'agreement|disclosure|fee|pdf|pricing|rate|terms')) GROUP BY 1)
SELECT page_id, CASE WHEN regexp_matches(head, '^https?://') THEN head || path || coalesce('?' || kept, '') END AS source_url FROM t LEFT JOIN k USING (page_id)""")  # fmt: skip
def source_urls(spark, sf_dir):
    """The URL that names each page's source, whatever a link adds to it."""
    return read(spark, sf_dir, "pages").withColumn("link", F.expr(LINKED.format("STRING"))).select("page_id", tx.source_url(F.col("link")).alias("source_url"))


@query(rf"""
WITH u AS (SELECT page_id, {LINKED.format('VARCHAR')} AS link FROM pages), h AS (SELECT page_id, link, regexp_replace(regexp_replace(lower(regexp_extract(trim(link), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/:?#]*)', 1)), '^\.+|\.+$', '', 'g'), '^www\.', '') AS name FROM u),
s AS (SELECT *, lower(regexp_extract(link, '://([^/:?#]*)', 1)) AS host, regexp_extract(lower(link), '://([^./:?#]*)', 1) AS label, [x for x in string_split(regexp_extract(lower(link), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') if x <> ''][1:3] AS seg FROM h)
SELECT page_id, CASE WHEN contains(name, '.') AND NOT regexp_matches(name, '^[0-9.]+$') AND name <> 'localhost' THEN name END AS domain,
  label IN ('fr', 'es', 'de', 'it', 'pt', 'zh', 'ja', 'ko') OR coalesce([x for x in [split_part(replace(y, '_', '-'), '-', 1) for y in seg] if x IN ('en', 'fr', 'es', 'de', 'it', 'pt', 'zh', 'ja', 'ko')][1] <> 'en', false) AS other_locale,
  (split_part(host, '.', 1) = 'us' OR host LIKE '%.us' OR len([x for x in seg if regexp_matches(replace(x, '_', '-'), '^([a-z]{{2}}-)?us$')]) > 0) AND NOT (split_part(host, '.', 1) = 'ca' OR host LIKE '%.ca' OR len([x for x in seg if regexp_matches(replace(x, '_', '-'), '^([a-z]{{2}}-)?ca$')]) > 0) AS other_market FROM s""")  # fmt: skip
def url_conflicts(spark, sf_dir):
    """Official domain of each link, and whether it belongs to another language than English or another market than Canada."""
    link = F.col("link")
    return read(spark, sf_dir, "pages").withColumn("link", F.expr(LINKED.format("STRING"))).select("page_id", tx.official_domain(link).alias("domain"), tx.locale_conflict(link, "en").alias("other_locale"), tx.market_conflict(link, "ca").alias("other_market"))


@query(sql(r"""
WITH u AS (SELECT bank_code, 0 AS priority, homepage_url AS url FROM bank WHERE status = 'active' UNION ALL SELECT concat('B', CAST(page_id % 10 AS VARCHAR)), 1, url FROM pages),
d AS (SELECT bank_code, priority, regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '^www\.', '') AS domain FROM u), m AS (SELECT bank_code, domain, min(priority) AS priority FROM d WHERE contains(domain, '.') GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY bank_code ORDER BY priority, domain) AS k FROM m) SELECT bank_code, string_agg(domain, ',' ORDER BY k) AS domains FROM k WHERE k <= 5 GROUP BY 1""", "bank"))  # fmt: skip
def registered_domains(spark, sf_dir):
    """Domains of each bank, its own homepage first, five at most."""
    homes = read(spark, sf_dir, "bank").where("status = 'active'").select("bank_code", F.lit(0).alias("priority"), F.col("homepage_url").alias("url"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("B"), (F.col("page_id") % 10).cast("string")).alias("bank_code"), F.lit(1).alias("priority"), "url")
    each = homes.unionByName(pages).withColumn("domain", tx.official_domain(F.col("url"))).where("domain IS NOT NULL").groupBy("bank_code", "domain").agg(F.min("priority").alias("priority"))
    kept = latest_per_key(each, ["bank_code"], [F.asc("priority"), F.asc("domain")], 5, "place")
    return kept.groupBy("bank_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda d: d["domain"]), ",").alias("domains"))


TITLED = r"""
t AS (SELECT page_id, url, lower(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS title, lower(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g'))) AS heading, page_id % 3 AS bank FROM pages)"""


@query(rf"""
WITH {TITLED}, g AS (SELECT *, first_value(page_id) OVER w AS preferred_id, count(*) OVER (PARTITION BY bank, title, heading) AS n FROM t WHERE title <> '' AND heading <> '' WINDOW w AS (PARTITION BY bank, title, heading ORDER BY length(url), url, page_id))
SELECT page_id, preferred_id, CASE WHEN page_id <> preferred_id THEN url END AS alias, CAST(n AS BIGINT) AS n FROM g""")
def preferred_details(spark, sf_dir):
    """Of pages of a bank with one title and heading that with the shortest URL, and each other page as an alias of it.

    The choice is an aggregation, and its result goes back to the pages by a join, so an identity that very many
    pages share is in no row and no task whole.
    """
    clean = lambda pattern: F.lower(tx.collapsed(F.regexp_extract("html", pattern, 1)))
    own = read(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 3).alias("bank"), clean(discovery.TITLE).alias("title"), clean(discovery.HEADING).alias("heading")).where("title <> '' AND heading <> ''")
    own = own.select("page_id", "url", F.sha2(F.concat_ws("\n", F.col("bank").cast("string"), "title", "heading"), 256).alias("identity"))
    best = own.groupBy("identity").agg(F.min(F.struct(F.length("url").alias("size"), "url", "page_id")).alias("best"), F.count("*").alias("n"))
    return own.join(best, "identity").select("page_id", F.col("best.page_id").alias("preferred_id"), F.when(F.col("page_id") != F.col("best.page_id"), F.col("url")).alias("alias"), "n")


#: What fetching a page gave: redirects, other types, failures.
OBSERVED = "page_id AS source_id, url AS expected_url, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN concat(url, '/moved') ELSE url END AS final_url, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS source_type, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type"
DRIFT = f"""
o AS (SELECT {OBSERVED} FROM pages),
drift AS (SELECT source_id, 'fetch_failed' AS issue_code, 'error' AS severity, expected_url, NULL AS detected_url FROM o WHERE final_url IS NULL UNION ALL SELECT source_id, 'final_url_changed', 'warning', expected_url, final_url FROM o WHERE final_url <> expected_url
  UNION ALL SELECT source_id, 'content_type_changed', 'warning', expected_url, final_url FROM o WHERE final_url IS NOT NULL AND ((source_type = 'pdf' AND content_type NOT LIKE 'application/pdf%') OR (source_type = 'html' AND content_type NOT LIKE 'text/html%')))"""


def drift(spark, sf_dir):
    return discovery.drifted(read(spark, sf_dir, "pages").selectExpr(f"struct({OBSERVED}) AS o").select("o.*"))


@query(f"WITH {DRIFT} SELECT * FROM drift")
def registry_drift(spark, sf_dir):
    """What has changed about registered sources: one row for each issue."""
    return drift(spark, sf_dir)


@query(rf"""
WITH {DRIFT}, links AS (SELECT DISTINCT page_id AS source_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)', 1)) AS target FROM pages),
warned AS (SELECT 'out_of_registry_link' AS change_type, 'warning' AS severity, CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS VARCHAR) AS expected_url, target AS detected_url FROM links WHERE target LIKE '/a%'),
missing AS (SELECT 'source_missing_from_discovery', 'warning', page_id, url, NULL FROM pages WHERE page_id NOT IN (SELECT source_id FROM links WHERE target LIKE '/t%'))
SELECT DISTINCT change_type, severity, source_id, expected_url, detected_url FROM (SELECT issue_code AS change_type, severity, source_id, expected_url, detected_url FROM drift UNION ALL SELECT * FROM warned UNION ALL SELECT * FROM missing)""")  # fmt: skip
def refresh_differences(spark, sf_dir):
    """Drift, links to what isn't registered, and sources that no link found again, each difference once."""
    pages = read(spark, sf_dir, "pages")
    links = pages.select(F.col("page_id").alias("source_id"), F.explode(F.regexp_extract_all("html", F.lit(discovery.HREF), F.lit(1))).alias("target"))
    seen = links.where("target LIKE '/t%'").select("source_id").distinct()
    return discovery.refresh_differences(drift(spark, sf_dir), links.where("target LIKE '/a%'").select(F.col("target").alias("detected_url")), pages.select(F.col("page_id").alias("source_id"), F.col("url").alias("expected_url")).join(seen, "source_id", "left_anti"))


@query(r"""
WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)', 1))) AS target FROM pages), s AS (SELECT page_id, target, lower(target) AS f FROM l),
h AS (SELECT page_id, target, CASE WHEN regexp_matches(f, 'login|careers') THEN -8 ELSE 2 * CAST(contains(f, 'th') AS INTEGER) + 2 * CAST(contains(f, 'an') AS INTEGER) + CAST(contains(f, 'er') AS INTEGER) - CAST(contains(f, 'fee') AS INTEGER) - CAST(contains(f, 'ing') AS INTEGER) END AS heuristic FROM s)
SELECT page_id, target, heuristic, CAST(2.0 * heuristic + CASE length(target) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 5.5 WHEN 2 THEN 1.25 ELSE 2.0 END + CASE length(target) % 4 WHEN 1 THEN 2.0 WHEN 2 THEN -1.0 WHEN 3 THEN -3.0 ELSE 0.0 END AS DOUBLE) AS combined FROM h""")  # fmt: skip
def link_scores(spark, sf_dir):
    """How promising links are: by their words, and together with a model's relevance and role where there are those."""
    links = discovery.links(read(spark, sf_dir, "pages")).select("page_id", "target").withColumn("k", F.length("target") % 4)
    relevance = F.when(F.col("k") == 1, 5.5).when(F.col("k") == 2, 1.25).when(F.col("k") == 3, 2.0)
    role = F.when(F.col("k") == 1, "detail").when(F.col("k") == 2, "supporting_html").when(F.col("k") == 3, "irrelevant")
    heuristic = discovery.link_score(F.lower("target"), {"th": 2, "an": 2, "er": 1, "fee": -1, "ing": -1}, ["login", "careers"])
    return links.select("page_id", "target", heuristic.alias("heuristic"), discovery.combined_score(heuristic, relevance, role).alias("combined"))
