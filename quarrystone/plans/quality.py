"""Validation and routing of products, conflicts of evidence, contracts, subtypes and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import quality
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

CHECKED = """
WITH c AS (SELECT *, coalesce(direct_rate, posted_rate) AS rate, coalesce(display_fee, monthly_fee) AS fee FROM product),
i AS (SELECT product_id, status, rate, fee, minimum_balance, subtype_code, tags, CASE WHEN subtype_code IS NULL THEN 'ambiguous_subtype' END AS i1, CASE WHEN fee >= 22 THEN 'fee_out_of_range' END AS i2, CASE WHEN direct_rate <> posted_rate THEN 'inconsistent_rate' END AS i3,
  CASE WHEN minimum_balance IS NULL AND minimum_deposit IS NULL THEN 'missing_amounts' END AS i4, CASE WHEN rate IS NULL THEN 'required_field_missing' END AS i5 FROM c),
v AS (SELECT *, concat_ws(',', i1, i2, i3, i4, i5) AS issues, CASE WHEN i2 IS NOT NULL OR i5 IS NOT NULL THEN 'error' WHEN i1 IS NOT NULL OR i3 IS NOT NULL OR i4 IS NOT NULL THEN 'warning' ELSE 'pass' END AS validation_status,
  round(greatest(0.0, least(0.99, 0.45 * CASE WHEN rate IS NOT NULL THEN 1.0 ELSE 0.0 END + 0.35 * CASE WHEN fee IS NOT NULL THEN 1.0 ELSE 0.0 END + 0.2 * CASE WHEN minimum_balance IS NOT NULL THEN 1.0 ELSE 0.0 END - CASE WHEN i3 IS NOT NULL THEN 0.1 ELSE 0.0 END)), 4) AS confidence FROM i)
"""


def checked(spark, sf_dir):
    """Products with issue codes, status and confidence."""
    df = read(spark, sf_dir, "product").withColumn("rate", F.coalesce("direct_rate", "posted_rate")).withColumn("fee", F.coalesce("display_fee", "monthly_fee"))
    known = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    differs = F.coalesce(F.col("direct_rate") != F.col("posted_rate"), F.lit(False))
    codes = quality.issue_codes([("ambiguous_subtype", F.col("subtype_code").isNull()), ("fee_out_of_range", F.col("fee") >= 22), ("inconsistent_rate", differs), ("missing_amounts", F.col("minimum_balance").isNull() & F.col("minimum_deposit").isNull()), ("required_field_missing", F.col("rate").isNull())])
    df = df.withColumn("codes", codes)
    return df.withColumn("validation_status", quality.severity(F.col("codes"), ["fee_out_of_range", "required_field_missing"])).withColumn("confidence", quality.weighted([(0.45, known("rate")), (0.35, known("fee")), (0.2, known("minimum_balance"))], [(0.1, differs)]))


@query(sql(CHECKED + "SELECT product_id, issues, validation_status, CAST(confidence AS DOUBLE) AS confidence FROM v", "product"))
def validated_products(spark, sf_dir):
    return checked(spark, sf_dir).select("product_id", F.array_join("codes", ",").alias("issues"), "validation_status", "confidence")


@query(sql(CHECKED + "SELECT product_id, CASE WHEN validation_status = 'error' THEN 'validation_error' WHEN i3 IS NOT NULL THEN 'conflicting_evidence' WHEN confidence < 0.6 THEN 'low_confidence' WHEN status <> 'active' THEN 'inactive' END AS reason, CASE WHEN validation_status = 'error' OR i3 IS NOT NULL OR confidence < 0.6 OR status <> 'active' THEN 'in_review' ELSE 'auto_validated' END AS candidate_state FROM v", "product"))
def routed_products(spark, sf_dir):
    """The first rule that asks for a review, or none."""
    rules = [(F.col("validation_status") == "error", "validation_error"), (F.array_contains("codes", "inconsistent_rate"), "conflicting_evidence"), (F.col("confidence") < 0.6, "low_confidence"), (F.col("status") != "active", "inactive")]
    return checked(spark, sf_dir).withColumn("reason", quality.first_match(rules)).select("product_id", "reason", F.when(F.col("reason").isNotNull(), "in_review").otherwise("auto_validated").alias("candidate_state"))


@query(sql(CHECKED + "SELECT unnest(string_split(issues, ',')) AS code, CASE WHEN validation_status = 'error' THEN 'error' ELSE 'warning' END AS severity, CAST(count(*) AS BIGINT) AS n FROM v WHERE issues <> '' GROUP BY 1, 2", "product"))
def issue_summary(spark, sf_dir):
    return checked(spark, sf_dir).select(F.explode("codes").alias("code"), F.when(F.col("validation_status") == "error", "error").otherwise("warning").alias("severity")).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(sql("SELECT product_id, field_name, CAST(n AS BIGINT) AS n_values FROM (SELECT product_id, 'rate' AS field_name, count(DISTINCT rate_value) AS n FROM version GROUP BY 1 UNION ALL SELECT product_id, 'note', count(DISTINCT note) FROM version GROUP BY 1) WHERE n > 1", "version"))
def conflicting_evidence(spark, sf_dir):
    values = read(spark, sf_dir, "version").select("product_id", F.inline(F.array(F.struct(F.lit("rate").alias("field_name"), F.col("rate_value").cast("string").alias("v")), F.struct(F.lit("note").alias("field_name"), F.col("note").alias("v")))))
    return quality.conflicts(values, "product_id", "field_name", "v")


@query(sql("SELECT product_id, field, value FROM (SELECT product_id, 'tags' AS field, tags AS value FROM product UNION ALL SELECT product_id, 'subtype_code', subtype_code FROM product UNION ALL SELECT product_id, 'product_name', substr(product_id, 2) FROM product WHERE false) WHERE value IS NOT NULL", "product"))
def contract_breaches(spark, sf_dir):
    """Texts under contracts of numbers and flags: here none of them casts, so all values break theirs."""
    return quality.contract_breaches(read(spark, sf_dir, "product"), "product_id", {"tags": "double", "subtype_code": "boolean"})


@query(sql("""
SELECT product_id, CASE WHEN product_name LIKE '%gold%' OR product_name LIKE '%red%' THEN 'premium' WHEN length(product_name) % 3 = 0 THEN 'high_interest' WHEN coalesce(display_fee, monthly_fee) = 0 THEN 'no_fee' ELSE 'standard' END AS inferred,
  concat_ws(',', CASE WHEN contains(coalesce(tags, ''), 'student') THEN 'student' END, CASE WHEN minimum_balance >= 5000 THEN 'affluent' END, CASE WHEN coalesce(display_fee, monthly_fee) = 0 THEN 'budget' END) AS customers FROM product""", "product"))  # fmt: skip
def inferred_subtypes(spark, sf_dir):
    """Subtype by the first keyword rule that holds, and tags by all that do."""
    name, fee = F.col("product_name"), F.coalesce("display_fee", "monthly_fee")
    subtype = quality.first_match([(name.contains("gold") | name.contains("red"), "premium"), (F.length(name) % 3 == 0, "high_interest"), (fee == 0, "no_fee")], "standard")
    tags = F.array_compact(F.array(F.when(F.coalesce("tags", F.lit("")).contains("student"), "student"), F.when(F.col("minimum_balance") >= 5000, "affluent"), F.when(fee == 0, "budget")))
    return read(spark, sf_dir, "product").select("product_id", subtype.alias("inferred"), F.array_join(tags, ",").alias("customers"))


@query(sql("""
WITH r AS (SELECT product_id, version_no, rate_value, 30 * (1 + version_no % 24) AS days FROM version), d AS (SELECT DISTINCT product_id, days, rate_value FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY days, rate_value) AS pos FROM d)
SELECT product_id, CAST(count(*) AS BIGINT) AS n_rows, max(rate_value) AS best_rate, max(CASE WHEN days BETWEEN 330 AND 395 THEN rate_value END) AS year_rate FROM k WHERE pos <= 24 GROUP BY 1""", "version"))
def term_rate_tables(spark, sf_dir):
    """Rate tables as arrays of rows: distinct, ordered, at most 24, with the best rate and that of about a year."""
    row = F.struct((30 * (1 + F.col("version_no") % 24)).alias("days"), "rate_value")
    table = F.slice(F.array_sort(F.collect_set(row)), 1, 24)
    best = lambda rows: F.array_max(F.transform(rows, lambda r: r["rate_value"]))
    return read(spark, sf_dir, "version").groupBy("product_id").agg(table.alias("t")).select("product_id", F.size("t").cast("bigint").alias("n_rows"), best(F.col("t")).alias("best_rate"), best(F.filter("t", lambda r: r["days"].between(330, 395))).alias("year_rate"))


@query(sql("""
WITH s AS (SELECT product_id, rate_value, row_number() OVER (PARTITION BY product_id ORDER BY version_no DESC) AS k FROM version WHERE note = 'N')
SELECT product.product_id, coalesce(direct_rate, posted_rate, rate_value) AS rate, CASE WHEN direct_rate IS NOT NULL THEN 'direct' WHEN posted_rate IS NOT NULL THEN 'posted' WHEN rate_value IS NOT NULL THEN 'supporting' END AS origin
FROM product LEFT JOIN s ON s.product_id = product.product_id AND k = 1""", "product", "version"))
def supporting_merge(spark, sf_dir):
    """Gaps of a product filled from its newest supporting row, with where each value came from."""
    from quarrystone.operators.picks import latest_per_key

    support = latest_per_key(read(spark, sf_dir, "version").where("note = 'N'"), ["product_id"], [F.desc("version_no")]).select("product_id", "rate_value")
    origin = quality.first_match([(F.col("direct_rate").isNotNull(), "direct"), (F.col("posted_rate").isNotNull(), "posted"), (F.col("rate_value").isNotNull(), "supporting")])
    return read(spark, sf_dir, "product").join(support, "product_id", "left").select("product_id", F.coalesce("direct_rate", "posted_rate", "rate_value").alias("rate"), origin.alias("origin"))
