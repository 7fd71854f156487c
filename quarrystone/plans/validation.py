"""Validation of candidates against what they say, what backs it, and what their market asks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import validation
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

DAY = "2026-04-13"
#: Fields that the evidence of each candidate backs.
BACKED = ("product_name", "monthly_fee", "minimum_balance", "minimum_deposit", "term_length_days", "redeemable_flag", "included_transactions", "fee_waiver_condition", "public_display_rate")
_SUBTYPES = " OR ".join(f"(product_type = '{kind}' AND coalesce(subtype_code IN {subtypes}, true))" for kind, subtypes in validation.TAXONOMY.items())


def judged(spark, sf_dir):
    """Candidates with their evidence as a list."""
    backed = [F.struct(F.lit(f).alias("field"), F.lit("x").alias("value"), F.lit(None).cast("string").alias("excerpt")) for f in BACKED]
    rates = [F.struct(F.lit("standard_rate").alias("field"), F.col(v).alias("value"), e.alias("excerpt")) for v, e in (("standard_rate", F.col("excerpt")), ("linked_rate", F.lit(None).cast("string")))]
    df = read(spark, sf_dir, "judged").withColumn("evidence", F.array(*backed, *rates)).withColumn("notes", F.array("note")).withColumn("reasons", F.array("reason")).withColumn("expected", F.array().cast("array<string>"))
    return validation.issues(df, F.lit(DAY).cast("date"))


ISSUES = f"""
WITH p AS (SELECT *, CAST(payload AS JSON) AS j FROM judged), v AS (SELECT *, CAST(standard_rate AS DOUBLE) AS rate, CASE WHEN json_type(j, '$.monthly_fee') = 'VARCHAR' THEN 0.0 ELSE CAST(j ->> '$.monthly_fee' AS DOUBLE) END AS fee, CAST(j ->> '$.minimum_balance' AS DOUBLE) AS balance, CAST(j ->> '$.public_display_rate' AS DOUBLE) AS shown,
  j ->> '$.non_redeemable_flag' IS NOT NULL AS both_flags, j ->> '$.unlimited_transactions_flag' IS NOT NULL AS unlimited, j ->> '$.term_length_days' AS days, country_code = 'JP' AS elsewhere, country_code = 'US' AS us FROM p),
c AS (SELECT candidate_id, [CASE WHEN source_language = 'English' THEN 'ambiguous_mapping' END, CASE WHEN reason = 'hub_page_not_detail' THEN 'ambiguous_product_boundary' END,
  CASE WHEN linked_rate <> standard_rate AND NOT elsewhere AND product_type <> 'chequing' THEN 'conflicting_evidence' END,
  CASE WHEN coalesce(shown < rate, false) OR (product_type = 'chequing' AND (product_name = 'No-Fee Banking' AND fee > 0 OR unlimited)) OR both_flags OR contains(excerpt, '2020') THEN 'inconsistent_cross_field_logic' END,
  CASE WHEN json_type(j, '$.monthly_fee') = 'VARCHAR' OR days = '1.5' THEN 'invalid_field_type' END, CASE WHEN rate >= 10 OR fee >= 500 OR coalesce(balance < 0, false) THEN 'invalid_numeric_range' END, CASE WHEN NOT ({_SUBTYPES}) THEN 'invalid_taxonomy_code' END,
  CASE WHEN days IN ('0', '1.5') THEN 'invalid_term_value' END, CASE WHEN note = 'partial read' THEN 'partial_source_failure' END,
  CASE WHEN currency = '' OR j ->> '$.last_verified_at' = 'soon' OR elsewhere OR CASE product_type WHEN 'savings' THEN balance IS NULL AND NOT us OR us AND fee > 0 WHEN 'chequing' THEN CASE WHEN us THEN fee > 0 ELSE fee > 0 AND balance IS NULL END ELSE us END THEN 'required_field_missing' END] AS codes FROM v)
SELECT candidate_id, array_to_string([x for x in codes if x IS NOT NULL], ',') AS codes, CASE WHEN len([x for x in codes if x IN {validation.ERRORS}]) > 0 THEN 'error' WHEN len([x for x in codes if x IS NOT NULL]) > 0 THEN 'warning' ELSE 'pass' END AS validation_status FROM c"""


@query(sql(ISSUES, "judged"))
def candidate_issues(spark, sf_dir):
    """Codes of what is wrong with each candidate, and the status that follows."""
    return judged(spark, sf_dir).select("candidate_id", F.array_join("codes", ",").alias("codes"), "validation_status")
