"""Names, URLs, rates, duplicates, chunks, embeddings and retrieval over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import text as tx
from quarrystone.operators import evidence
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query(sql(r"""
SELECT product_id, regexp_replace(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), ' account$', '') AS name_key, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') AS identity,
  regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'product-' || substr(sha256(product_id || '|' || n), 1, 16) AS short_id, trim(regexp_replace(n, '\s+', ' ', 'g')) AS collapsed
FROM (SELECT product_id, ' ' || product_name || ' (' || product_type || ')  Account ' AS n FROM product)""", "product"))  # fmt: skip
def name_keys(spark, sf_dir):
    df = read(spark, sf_dir, "product").select("product_id", F.concat(F.lit(" "), "product_name", F.lit(" ("), "product_type", F.lit(")  Account ")).alias("n"))
    n = F.col("n")
    return df.select("product_id", tx.name_key(n).alias("name_key"), tx.identity(n).alias("identity"), tx.slug(n).alias("slug"), tx.short_id("product", F.col("product_id"), n).alias("short_id"), tx.collapsed(n).alias("collapsed"))


@query(sql("SELECT DISTINCT product_type, CASE product_type WHEN 'credit-card' THEN 'Credit Card' WHEN 'personal-loan' THEN 'Personal Loan' ELSE upper(product_type[1]) || product_type[2:] END AS label FROM product", "product"))
def type_labels(spark, sf_dir):
    return read(spark, sf_dir, "product").select("product_type").distinct().withColumn("label", tx.human(F.col("product_type")))


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS bare, url FROM pages),
p AS (SELECT page_id, url, lower(regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)', 1)) AS head, regexp_extract(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, regexp_extract(bare, '\?(.*)$', 1) AS q FROM u),
k AS (SELECT page_id, string_agg(x, '&' ORDER BY x) AS kept FROM (SELECT page_id, unnest(string_split(q, '&')) AS x FROM p) WHERE split_part(x, '=', 1) IN ('id', 'page', 'product') GROUP BY 1)
SELECT page_id, regexp_replace(regexp_replace(head, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/$', '') || CASE WHEN kept IS NOT NULL THEN '?' || kept ELSE '' END AS url,
  regexp_replace(lower(regexp_extract(p.url, '://([^/:?#]*)', 1)), '^www\.', '') AS host, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'html' END AS source_type,
  regexp_replace(lower(regexp_extract(p.url, '://([^/:?#]*)', 1)), '^www\.', '') LIKE '%.example.com' OR regexp_replace(lower(regexp_extract(p.url, '://([^/:?#]*)', 1)), '^www\.', '') = 'example.com' AS official FROM p LEFT JOIN k USING (page_id)""")  # fmt: skip
def page_urls(spark, sf_dir):
    """Normalised URL, host, source type and domain test of every page."""
    url = F.col("url")
    kind = F.when(F.lower(F.regexp_extract(F.regexp_replace(url, "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1)).endswith(".pdf"), "pdf").otherwise("html")
    return read(spark, sf_dir, "pages").select("page_id", tx.url(url).alias("url"), tx.host(url).alias("host"), kind.alias("source_type"), tx.in_domain(url, "example.com").alias("official"))


@query(sql(r"""
WITH t AS (SELECT product_id, 'Earn ' || CAST(coalesce(direct_rate, 0) AS VARCHAR) || '% for ' || CAST(1 + length(product_name) % 9 AS VARCHAR) || ' months' AS offer, CASE WHEN monthly_fee IS NULL THEN 'No monthly fee' ELSE '$' || CAST(monthly_fee AS VARCHAR) END AS fee_text,
  CASE WHEN length(product_name) % 2 = 0 THEN 'March ' || CAST(1 + length(product_name) % 28 AS VARCHAR) || ', 2025' ELSE '2025-04-09' END AS day_text, CAST(1 + length(product_name) % 5 AS VARCHAR) || CASE length(product_name) % 3 WHEN 0 THEN ' years' WHEN 1 THEN ' months' ELSE ' days' END AS term FROM product)
SELECT product_id, CAST(regexp_extract(offer, '([0-9.]+)%', 1) AS DOUBLE) AS promotional_rate, CASE WHEN fee_text LIKE 'No%' THEN 0.0 ELSE CAST(substr(fee_text, 2) AS DOUBLE) END AS fee,
  CASE WHEN day_text LIKE 'March%' THEN CAST(strptime(day_text, '%B %d, %Y') AS DATE) ELSE CAST(day_text AS DATE) END AS day,
  CAST(split_part(term, ' ', 1) AS INTEGER) * CASE split_part(term, ' ', 2) WHEN 'years' THEN 365 WHEN 'months' THEN 30 ELSE 1 END AS term_days FROM t""", "product"))  # fmt: skip
def parsed_terms(spark, sf_dir):
    """Rates, fees, dates and terms read back from the words that a page would use."""
    size = F.length("product_name")
    offer = F.concat(F.lit("Earn "), F.coalesce("direct_rate", F.lit(0.0)).cast("string"), F.lit("% for "), (1 + size % 9).cast("string"), F.lit(" months"))
    fee = F.when(F.col("monthly_fee").isNull(), "No monthly fee").otherwise(F.concat(F.lit("$"), F.col("monthly_fee").cast("string")))
    day = F.when(size % 2 == 0, F.concat(F.lit("March "), (1 + size % 28).cast("string"), F.lit(", 2025"))).otherwise("2025-04-09")
    term = F.concat((1 + size % 5).cast("string"), F.when(size % 3 == 0, " years").when(size % 3 == 1, " months").otherwise(" days"))
    return read(spark, sf_dir, "product").select("product_id", tx.promotional_rate(offer).alias("promotional_rate"), tx.fee(fee).alias("fee"), tx.day(day).alias("day"), tx.term_days(term).alias("term_days"))


@query("SELECT sha256(concat('text/plain', chr(10), coalesce(text, ''))) AS fingerprint, CAST(count(*) AS BIGINT) AS n_same, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def snapshot_dedupe(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return evidence.first_snapshots(docs, "text/plain", "text", [F.col("doc_id")])


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS line FROM l)
SELECT sha256(line) AS line_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(length(any_value(line)) AS BIGINT) AS n_chars FROM n WHERE length(line) >= 80 GROUP BY sha256(line) HAVING count(DISTINCT doc_id) >= 2""")
def duplicate_lines(spark, sf_dir):
    """Lines of 80 characters or more that two documents share, whatever their case and spacing."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.lower(tx.collapsed(F.col("line"))).alias("line")).where(F.length("line") >= 80)
    return lines.select("doc_id", F.sha2("line", 256).alias("line_id"), F.length("line").cast("bigint").alias("n_chars")).distinct().groupBy("line_id").agg(F.count("*").alias("n_docs"), F.any_value("n_chars").alias("n_chars")).where("n_docs >= 2")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l""")
def segment_offsets(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return evidence.with_offsets(lines, "doc_id", "pos", "line").select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "start")


@query()
def document_chunks(spark, sf_dir):
    """Overlapping chunks with ids; their boundaries follow from those before, which SQL does not express."""
    chunks = evidence.chunked(read(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_index", "start", "stop", tx.short_id("chunk", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), F.col("chunk")).alias("chunk_id"))


@query(r"""
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark), h AS (SELECT item_id, sha256(token) AS digest FROM t),
s AS (SELECT item_id, CAST(CAST('0x' || substr(digest, 1, 8) AS BIGINT) % 64 AS INTEGER) AS dimension, sum(CASE WHEN CAST('0x' || substr(digest, 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS total FROM h GROUP BY 1, 2)
SELECT item_id, dimension, round(total / sqrt(CAST(sum(total * total) OVER (PARTITION BY item_id) AS DOUBLE)), 6) AS value FROM s WHERE total <> 0""")
def hashed_embeddings(spark, sf_dir):
    return evidence.hashed_embedding(read(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 5""")
def nearest_vectors(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return evidence.nearest(vectors, vectors.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"))


FIELDS = [("rate", ["the", "ing", "tion", "erth"], ["the ", "of the"]), ("fee", ["die", "der", "und", "ein"], ["die ", "und "]), ("term", ["les", "que", "para", "las"], ["que ", "de la"])]


@query("""
WITH f AS (SELECT * FROM (VALUES ('rate', ['the', 'ing', 'tion', 'erth'], ['the ', 'of the']), ('fee', ['die', 'der', 'und', 'ein'], ['die ', 'und ']), ('term', ['les', 'que', 'para', 'las'], ['que ', 'de la'])) x(field, hints, phrases)),
b AS (SELECT item_id, lower(text) AS l, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, CASE item_id % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'fee' ELSE 'term' END AS anchor FROM benchmark),
s AS (SELECT field, item_id, round(least(0.99, least(0.55, 0.12 * len(list_intersect(tokens, hints))) + least(0.25, 0.12 * len([1 for p in phrases if contains(l, p)])) + CASE WHEN anchor = field THEN 0.05 ELSE 0.0 END), 4) AS score FROM b, f)
SELECT field, item_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, item_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")  # fmt: skip
def retrieved_evidence(spark, sf_dir):
    fields = spark.createDataFrame(FIELDS, "field string, hints array<string>, phrases array<string>")
    chunks = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.lower("text").alias("lowered"), tx.tokens(F.col("text")).alias("tokens"), F.expr("CASE item_id % 3 WHEN 0 THEN 'rate' WHEN 1 THEN 'fee' ELSE 'term' END").alias("anchor"))
    return evidence.retrieved(chunks, fields).select("field", F.col("chunk_id").alias("item_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, event_type || ':' || json_extract_string(props, '$.k') AS label FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def payload_fields(spark, sf_dir):
    """Values of a JSON payload, typed where they can be."""
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select("event_id", k.try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"), F.concat_ws(":", "event_type", k).alias("label")).where("k BETWEEN 10 AND 20")


@query("""
SELECT event_type, string_agg(k || '=' || n, ',' ORDER BY k) AS merged FROM (SELECT event_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS k, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2) WHERE k <> '3' GROUP BY 1""")
def payload_maps(spark, sf_dir):
    """Maps built from rows, compacted to the keys that are wanted, written out in order."""
    counts = read(spark, sf_dir, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("bigint") % 10).cast("string").alias("k")).agg(F.count("*").cast("string").alias("n"))
    kept = F.map_filter(F.map_from_entries(F.collect_list(F.struct("k", "n"))), lambda k, v: k != "3")
    return counts.groupBy("event_type").agg(kept.alias("m")).select("event_type", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))
