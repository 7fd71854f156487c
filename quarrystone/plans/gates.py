r"""Evidence and gates: hybrid retrieval, choice of fields, grounding, validation issues, confidence, diagnosis, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import fieldrules
from quarrystone.functions import text as tx
from quarrystone.operators import gates, quality
from quarrystone.operators.picks import latest_per_key
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

# Words and phrases that speak for evidence of a field. Those of more than one word count as phrases, too.
HINTS = {
    "monthly_fee": ["monthly fee", "account fee", "service fee", "fee"],
    "minimum_deposit": ["minimum deposit", "minimum investment", "opening deposit", "deposit amount", "as little as"],
    "standard_rate": ["standard rate", "interest rate", "regular rate", "annual rate"],
    "promotional_rate": ["promotional rate", "bonus rate", "promo rate", "special rate"],
    "term_rate_table": ["term", "rate", "interest rate", "%", "months", "years"],
    "term_length_text": ["term", "term length", "year term", "month term", "days"],
    "redeemable_flag": ["redeemable", "cashable", "early redemption"],
    "eligibility_text": ["eligible", "eligibility", "qualify", "who can apply"],
    "payout_option": ["paid monthly", "paid annually", "at maturity", "interest paid"],
    "post_maturity_interest_rate": ["after maturity", "post-maturity", "maturity", "renewal", "reinvest"],
    "base_12_month_rate": ["12 month", "1 year", "one year", "annual rate", "standard rate", "interest rate"],
    "public_display_rate": ["interest rate", "rate", "earn", "%"],
    "interest_rate_summary": ["interest rate", "variable rate", "variable return", "linked to", "rate formula", "rate at time of purchase", "return", "%"],
    "promotional_period_text": ["promo period", "offer ends", "promotional period", "for the first"],
    "introductory_rate_flag": ["introductory", "promotional", "bonus"],
    "application_method": ["apply", "open account", "online", "branch", "mobile app", "phone"],
    "tax_benefits": ["tax free", "tax-free", "tax deferred", "tfsa", "rrsp", "tax benefit"],
    "deposit_insurance": ["cdic", "deposit insurance", "insured", "canada deposit insurance corporation"],
    "interest_calculation_method": ["calculated daily", "daily closing balance", "interest is calculated"],
    "interest_payment_frequency": ["paid monthly", "monthly", "interest is paid", "payment frequency"],
    "tiered_rate_flag": ["tiered", "tiers", "interest rate tiers"],
    "tier_definition_text": ["tier", "tiers", "balance range"],
    "withdrawal_limit_text": ["withdrawal", "withdrawals", "debit transaction", "transaction limit"],
    "registered_flag": ["tfsa", "rrsp", "registered"],
    "term_length_days": ["term", "year", "month", "days"],
    "non_redeemable_flag": ["non-redeemable", "non redeemable", "non-cashable", "non cashable"],
    "early_withdrawal_penalty": ["early withdrawal penalty", "penalty for early withdrawal", "withdraw before maturity", "days of interest", "months of interest"],
    "compounding_frequency": ["compounded", "compounding", "compound interest"],
    "registered_plan_supported": ["tfsa", "rrsp", "rrif", "registered plan", "registered account"],
    "included_transactions": ["transactions included", "debits included", "transactions per month", "free transactions"],
    "unlimited_transactions_flag": ["unlimited transactions", "unlimited debits", "unlimited banking"],
    "interac_e_transfer_included": ["interac e-transfer", "e-transfer included", "free e-transfer"],
    "overdraft_available": ["overdraft", "overdraft protection"],
    "cheque_book_info": ["cheque book", "cheques", "checks"],
    "student_plan_flag": ["student", "student banking", "youth"],
    "newcomer_plan_flag": ["newcomer", "new to canada"],
    "notes": ["note", "additional information", "important", "conditions apply"],
}
#: Chunks that are kept of a field, and of one that is a table.
KEPT, KEPT_OF_TABLES = 5, 12


def keywords(field: str) -> list[str]:
    """Hints of a field, the words of its name and the name itself, each once."""
    return list(dict.fromkeys([*HINTS.get(field, []), *field.split("_"), field.replace("_", " ")]))


def words(keys: list[str]) -> list[str]:
    import re

    return sorted({t for k in keys for t in re.findall("[a-z0-9]+", k)})


FIELDS = [(f, keywords(f), words(keywords(f)), [k for k in keywords(f) if " " in k]) for f in HINTS]
_LIST = lambda items: "[" + ", ".join("'" + i + "'" for i in items) + "]"
CHUNKS = """
c AS (SELECT product_id AS chunk_id, lower(offer_text) AS x, regexp_extract_all(lower(offer_text), '[a-z0-9]+') AS tokens, product_type AS anchor, CASE WHEN display_rate IS NULL THEN NULL ELSE display_rate / 100 END AS vector_score, product_family, product_type FROM offer WHERE offer_text IS NOT NULL AND product_type IN ('gic', 'mortgage', 'other'))"""


@query(sql(f"""
WITH f AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {_LIST(k)}, {_LIST(w)}, {_LIST(p)})" for f, k, w, p in FIELDS)}) x(field, keys, words, phrases)), {CHUNKS},
s AS (SELECT field, chunk_id, vector_score, least(0.99, least(0.55, 0.12 * len(list_intersect(list_distinct(tokens), words))) + least(0.25, 0.12 * len([1 for p in phrases if contains(x, p)])) + least(0.1, 0.05 * len([1 for k in keys if contains(anchor, k)]))
  + {fieldrules.signal_sql()}) AS lexical FROM c, f),
h AS (SELECT field, chunk_id, round(CAST(CASE WHEN vector_score IS NULL THEN lexical ELSE least(0.99, 0.55 * lexical + 0.45 * greatest(0.0, least(0.99, vector_score))) END AS DOUBLE), 4) AS score, CASE WHEN vector_score IS NULL THEN 'metadata-only' ELSE 'vector-assisted' END AS mode FROM s)
SELECT field, chunk_id, score, mode, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY score DESC, chunk_id) AS rank FROM h WHERE score > 0) WHERE rank <= CASE field WHEN 'term_rate_table' THEN {KEPT_OF_TABLES} ELSE {KEPT} END""", "offer"))  # fmt: skip
def hybrid_retrieval(spark, sf_dir):
    """Chunks of each field under metadata filters, scored by words, phrases, anchor and a field's own signal, with vector scores where there are any."""
    fields = spark.createDataFrame(FIELDS, "field string, keys array<string>, words array<string>, phrases array<string>")
    chunks = read(spark, sf_dir, "offer").where(F.col("offer_text").isNotNull())
    chunks = gates.filtered(chunks, {"product_type": ["gic", "mortgage", "other"], "product_family": []}).select(F.col("product_id").alias("chunk_id"), F.lower("offer_text").alias("x"), tx.tokens(F.col("offer_text")).alias("tokens"), F.col("product_type").alias("anchor"), (F.col("display_rate") / 100).alias("vector_score"))
    found = gates.hybrid(chunks, fields)
    kept = F.when(F.col("field") == "term_rate_table", KEPT_OF_TABLES).otherwise(KEPT)
    return latest_per_key(found.where("score > 0"), ["field"], [F.desc("score"), F.asc("chunk_id")], KEPT_OF_TABLES, "rank").where(F.col("rank") <= kept).select("field", "chunk_id", "score", "mode", F.col("rank").cast("bigint").alias("rank"))


CHOSEN = ("public_display_rate", "promotional_rate", "eligibility_text", "monthly_fee", "unlimited_transactions_flag")
OPTIONS = f"""
o AS (SELECT product_id, field, display_rate AS value, display_rate = 0 AS zero, lower(offer_text) AS x, product_type FROM (SELECT *, unnest({_LIST(CHOSEN)}) AS field FROM offer WHERE offer_text IS NOT NULL AND display_rate IS NOT NULL)),
m AS (SELECT *, CASE WHEN contains(x, 'offer') THEN 1 ELSE 0 END AS identity, {fieldrules.points_sql()} AS semantic FROM o)
"""


@query(sql(f"WITH {OPTIONS} SELECT product_type, field, product_id, value, identity, semantic FROM (SELECT *, row_number() OVER (PARTITION BY product_type, field ORDER BY identity DESC, semantic DESC, value DESC, product_id) AS k FROM m) WHERE k = 1", "offer"))
def chosen_fields(spark, sf_dir):
    """For each field the value whose evidence names the product, speaks for the field and matched best, in this order."""
    each = read(spark, sf_dir, "offer").where("offer_text IS NOT NULL AND display_rate IS NOT NULL").select("product_id", "product_type", F.col("display_rate").alias("value"), F.lower("offer_text").alias("x"), (F.col("display_rate") == 0).alias("zero"), F.explode(F.array(*map(F.lit, CHOSEN))).alias("field"))
    scored = each.withColumn("identity", F.when(F.col("x").contains("offer"), 1).otherwise(0)).withColumn("semantic", fieldrules.points())
    return latest_per_key(scored, ["product_type", "field"], [F.desc("identity"), F.desc("semantic"), F.desc("value"), F.asc("product_id")]).select("product_type", "field", "product_id", "value", "identity", "semantic")


QUOTES = """
q AS (SELECT product_id, offer_text, display_rate, product_type, CASE product_type WHEN 'gic' THEN concat('  ', upper(substr(offer_text, 1, 24)), ' ') WHEN 'mortgage' THEN concat(substr(offer_text, 1, 10), '...') WHEN 'credit-card' THEN substr(offer_text, 3, 5) ELSE 'interest   rate' END AS quote FROM offer)"""


@query(sql(f"WITH {QUOTES}, n AS (SELECT product_id, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(offer_text, '\\s+', ' ', 'g'))) AS t FROM q) SELECT product_id, coalesce(length(q) >= 8 AND NOT contains(q, '...') AND NOT contains(q, '…') AND contains(t, q), false) AS grounded FROM n", "offer"))
def grounded_quotes(spark, sf_dir):
    """Whether a quote stands word for word in its evidence."""
    kind, offer = F.col("product_type"), F.col("offer_text")
    quote = F.when(kind == "gic", F.concat(F.lit("  "), F.upper(F.substring(offer, 1, 24)), F.lit(" "))).when(kind == "mortgage", F.concat(F.substring(offer, 1, 10), F.lit("..."))).when(kind == "credit-card", F.substring(offer, 3, 5)).otherwise("interest   rate")
    return read(spark, sf_dir, "offer").select("product_id", F.coalesce(gates.grounded(quote, offer), F.lit(False)).alias("grounded"))


# Assumptions that a summary has to keep if its evidence states them; one of each group will do.
SCENARIOS = {
    "mortgage": [["down payment"], ["loan of $", "loan amount"], ["purchase transaction", "refinance transaction"], ["day lock", "rate lock"], ["ltv", "loan-to-value", "loan to value"], ["fico", "credit score"], ["owner-occupied", "owner occupied", "occupancy"], ["discount point", "points"], ["rates change daily", "rate may change", "rate can change"]],
    "personal-loan": [["ltv", "loan-to-value", "loan to value"], ["down payment"], ["credit history", "credit profile", "credit score", "excellent credit"], ["model year", "vehicle age"], ["origination fee"], ["relationship discount", "autopay discount", "automatic payment discount", "auto deduct discount"], ["automatic payments", "automatic payment", "autopay", "auto pay", "auto deduct"], ["qualifying checking", "qualifying deposit account", "qualifying account"], ["existing customer", "existing bank customer"], ["rates are subject to change", "rate may change", "rate can change"]],
    "savings": [["only available on new", "new savings account", "do not have an existing", "within the past 30 days"], ["within 30 days"], ["balance of at least", "minimum daily balance"], ["standard interest rate will be applied", "standard rate will apply"], ["apy shown is accurate as of", "rates as of", "rate is accurate as of"], ["rate is variable", "variable and may change", "subject to change"]],
}
_KEPT = " AND ".join(f"(NOT regexp_matches(e, '{'|'.join(g)}') OR regexp_matches(s, '{'|'.join(g)}'))".replace("$", "[$]") for g in SCENARIOS["mortgage"])
SUMMARY = "CASE WHEN product_type = 'mortgage' THEN concat('variable rate. ', CASE WHEN display_rate > 60 THEN 'Rate may change.' ELSE '' END) ELSE offer_text END"


@query(sql(f"WITH t AS (SELECT product_id, coalesce(lower(trim(regexp_replace({SUMMARY}, '\\s+', ' ', 'g'))), '') AS s, coalesce(lower(trim(regexp_replace(offer_text || CASE WHEN display_rate > 30 THEN ' Rates change daily' ELSE '' END, '\\s+', ' ', 'g'))), '') AS e FROM offer) SELECT product_id, s = '' OR e = '' OR ({_KEPT}) AS preserved FROM t", "offer"))
def preserved_scenarios(spark, sf_dir):
    """Whether a summary keeps every assumption that its evidence states."""
    evidence = F.concat("offer_text", F.when(F.col("display_rate") > 30, " Rates change daily").otherwise(""))
    return read(spark, sf_dir, "offer").select("product_id", gates.preserved(F.expr(SUMMARY), evidence, SCENARIOS["mortgage"]).alias("preserved"))


DATED = "concat('Rates shown as of ', CAST(2016 + version_no % 10 AS {0}), '-0', CAST(1 + version_no % 9 AS {0}), '-', CAST(1 + version_no % 30 AS {0}), '; rate as of 2025-1-3')"


@query(sql(f"WITH d AS (SELECT product_id, version_id, {DATED.format('VARCHAR')} AS e FROM version), x AS (SELECT *, TRY_CAST(regexp_extract(e, '(?i)\\brates?\\b[^.;:\\n]{{0,45}}?\\bas\\s+of\\s+([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})', 1) AS DATE) AS d FROM d) SELECT product_id, version_id, d AS as_of, coalesce(d < DATE '2021-04-13', false) AS stale FROM x", "version"))
def stale_evidence(spark, sf_dir):
    """Evidence of a rate that names a day more than five years before the reference day."""
    day = gates.as_of(F.expr(DATED.format("STRING")))
    return read(spark, sf_dir, "version").select("product_id", "version_id", day.alias("as_of"), F.coalesce(day < F.add_months(F.lit("2026-04-13").cast("date"), -60), F.lit(False)).alias("stale"))


TERMS = "CASE version_no % 4 WHEN 0 THEN '1 year term' WHEN 1 THEN '90 days to 18 months' WHEN 2 THEN 'open term' ELSE concat(CAST(version_no AS {0}), ' months') END"


@query(sql(f"""
WITH t AS (SELECT product_id, version_id, CAST(rate_value * 15 AS INTEGER) AS days, {TERMS.format('VARCHAR')} AS x FROM version),
l AS (SELECT *, [CAST(regexp_extract_all(x, '([0-9]{{1,3}})\\s*(day|month|year)s?\\b', 1)[i] AS INTEGER) * CASE regexp_extract_all(x, '([0-9]{{1,3}})\\s*(day|month|year)s?\\b', 2)[i] WHEN 'day' THEN 1 WHEN 'month' THEN 30 ELSE 365 END for i in range(1, len(regexp_extract_all(x, '([0-9]{{1,3}})\\s*(day|month|year)s?\\b', 1)) + 1)] AS ds FROM t)
SELECT product_id, version_id, len(ds) > 0 AND len([1 for d in ds if abs(days - d) <= greatest(7, round(d * 0.08))]) = 0 AND NOT (len(ds) > 1 AND days BETWEEN list_min(ds) AND list_max(ds)) AS conflicting FROM l""", "version"))  # fmt: skip
def term_conflicts(spark, sf_dir):
    """Whether a term in days contradicts the words beside it."""
    return read(spark, sf_dir, "version").select("product_id", "version_id", gates.term_conflict((F.col("rate_value") * 15).cast("int"), F.expr(TERMS.format("STRING"))).alias("conflicting"))


CANDIDATES = """
k AS (SELECT product_id, product_type, country_code, bank_code, product_family, product_name, status, subtype_code, direct_rate, posted_rate, display_fee, monthly_fee, minimum_balance, minimum_deposit, term_length_days, tags FROM product),
i AS (SELECT *, CASE WHEN subtype_code IS NULL THEN 'ambiguous_mapping' END AS c1, CASE WHEN posted_rate > direct_rate OR (product_type = 'chequing' AND display_fee <> monthly_fee) OR (product_type = 'gic' AND minimum_balance IS NOT NULL AND minimum_deposit IS NULL) THEN 'inconsistent_cross_field_logic' END AS c2,
  CASE WHEN direct_rate < 0 OR direct_rate >= 4.9 OR monthly_fee < 0 OR monthly_fee >= 19 OR minimum_balance < 0 THEN 'invalid_numeric_range' END AS c3, CASE WHEN subtype_code = 'premium' AND product_type = 'mortgage' THEN 'invalid_taxonomy_code' END AS c4, CASE WHEN term_length_days < 60 THEN 'invalid_term_value' END AS c5,
  CASE WHEN CASE product_type WHEN 'savings' THEN coalesce(direct_rate, posted_rate) IS NULL WHEN 'gic' THEN coalesce(direct_rate, posted_rate) IS NULL OR term_length_days IS NULL WHEN 'chequing' THEN coalesce(display_fee, monthly_fee) IS NULL ELSE false END THEN 'required_field_missing' END AS c6 FROM k),
v AS (SELECT *, concat_ws(',', c1, c2, c3, c4, c5, c6) AS codes, CASE WHEN coalesce(c2, c3, c4, c5, c6) IS NOT NULL THEN 'error' WHEN c1 IS NOT NULL THEN 'warning' ELSE 'pass' END AS validation_status FROM i)"""


def candidates(spark, sf_dir):
    """Products with the codes of what is wrong with them and a status."""
    c, rate, fee = F.col, F.coalesce("direct_rate", "posted_rate"), F.coalesce("display_fee", "monthly_fee")
    kind = c("product_type")
    rules = [
        ("ambiguous_mapping", c("subtype_code").isNull()),
        ("inconsistent_cross_field_logic", F.coalesce(c("posted_rate") > c("direct_rate"), F.lit(False)) | F.coalesce((kind == "chequing") & (c("display_fee") != c("monthly_fee")), F.lit(False)) | ((kind == "gic") & c("minimum_balance").isNotNull() & c("minimum_deposit").isNull())),
        ("invalid_numeric_range", gates.out_of_range(c("direct_rate"), 0, 4.9) | gates.out_of_range(c("monthly_fee"), 0, 19) | gates.out_of_range(c("minimum_balance"), 0, None)),
        ("invalid_taxonomy_code", F.coalesce((c("subtype_code") == "premium") & (kind == "mortgage"), F.lit(False))),
        ("invalid_term_value", c("term_length_days") < 60),
        ("required_field_missing", F.when(kind == "savings", rate.isNull()).when(kind == "gic", rate.isNull() | c("term_length_days").isNull()).when(kind == "chequing", fee.isNull()).otherwise(False)),
    ]
    errors = ["inconsistent_cross_field_logic", "invalid_numeric_range", "invalid_taxonomy_code", "invalid_term_value", "required_field_missing"]
    df = read(spark, sf_dir, "product").withColumn("codes", quality.issue_codes(rules))
    return df.withColumn("validation_status", quality.severity(c("codes"), errors))


MESSAGES = {"ambiguous_mapping": "The subtype could not be told.", "required_field_missing": "A field that comparisons need is missing.", "invalid_numeric_range": "A number lies outside its range."}


@query(sql(f"WITH {CANDIDATES}, e AS (SELECT product_id, unnest(string_split(codes, ',')) AS code FROM v WHERE codes <> '') SELECT product_id, code, CASE code WHEN 'ambiguous_mapping' THEN 'warning' ELSE 'error' END AS severity, CASE code WHEN 'ambiguous_mapping' THEN 'The subtype could not be told.' WHEN 'required_field_missing' THEN 'A field that comparisons need is missing.' WHEN 'invalid_numeric_range' THEN 'A number lies outside its range.' ELSE replace(code, '_', ' ') END AS summary FROM e", "product"))
def validation_issues(spark, sf_dir):
    """One row for each issue of a product, with its severity and a message."""
    return candidates(spark, sf_dir).select("product_id", F.explode("codes").alias("code")).select("product_id", "code", F.when(F.col("code") == "ambiguous_mapping", "warning").otherwise("error").alias("severity"), gates.labelled(F.col("code"), MESSAGES).alias("summary"))


EVIDENCE = "ev AS (SELECT product_id, avg(CAST(rate_value AS DOUBLE) / 50) AS mean, count(DISTINCT note) AS fields FROM version GROUP BY 1)"


@query(sql(f"""
WITH {CANDIDATES}, {EVIDENCE}, p AS (SELECT v.*, mean, fields, (CAST(country_code IS NOT NULL AS INTEGER) + CAST(bank_code IS NOT NULL AS INTEGER) + CAST(product_family IS NOT NULL AS INTEGER) + CAST(product_type IS NOT NULL AS INTEGER) + CAST(product_name IS NOT NULL AS INTEGER) + CAST(subtype_code IS NOT NULL AS INTEGER) + CAST(status IS NOT NULL AS INTEGER) + CAST(minimum_balance IS NOT NULL AS INTEGER)) / 8.0
  + CASE WHEN product_type = 'chequing' AND coalesce(display_fee, monthly_fee) IS NOT NULL OR product_type = 'savings' AND coalesce(direct_rate, posted_rate) IS NOT NULL OR product_type = 'gic' AND minimum_deposit IS NOT NULL THEN 0.1 ELSE 0.0 END AS complete FROM v LEFT JOIN ev USING (product_id))
SELECT product_id, floor(10000 * greatest(0.0, least(0.99, 0.28 * CAST(least(1.0, complete) AS DOUBLE) + 0.28 * coalesce(mean, 0.4) + 0.16 * least(1.0, coalesce(fields, 0) / 8.0) + 0.14 * (0.92 - CASE WHEN c1 IS NOT NULL THEN 0.15 ELSE 0.0 END) + 0.14 * 0.95
  - CASE validation_status WHEN 'warning' THEN 0.08 WHEN 'error' THEN 0.2 ELSE 0.0 END - CASE WHEN fields > 2 THEN 0.15 ELSE 0.0 END)) + 0.500001) / 10000 AS confidence FROM p""", "product", "version"))  # fmt: skip
def source_confidence(spark, sf_dir):
    """How far a candidate can be believed: completeness, evidence, coverage, mapping and parsing, less what validation found."""
    evidence = read(spark, sf_dir, "version").groupBy("product_id").agg(F.avg(F.col("rate_value").cast("double") / 50).alias("mean"), F.count_distinct("note").alias("fields"))
    df = candidates(spark, sf_dir).join(evidence, "product_id", "left")
    kind = F.col("product_type")
    bonus = ((kind == "chequing") & F.coalesce("display_fee", "monthly_fee").isNotNull()) | ((kind == "savings") & F.coalesce("direct_rate", "posted_rate").isNotNull()) | ((kind == "gic") & F.col("minimum_deposit").isNotNull())
    complete = gates.completeness(["country_code", "bank_code", "product_family", "product_type", "product_name", "subtype_code", "status", "minimum_balance"], bonus)
    score = gates.confidence(complete, F.col("mean"), F.col("fields"), F.array_contains("codes", "ambiguous_mapping"), F.col("validation_status"), F.col("fields") > 2)
    return df.select("product_id", (F.floor(10000 * score + 0.500001) / 10000).alias("confidence"))


@query(sql(f"""
WITH {CANDIDATES} SELECT product_id, CASE WHEN product_family = 'lending' AND product_type = 'personal-loan' THEN 'non_product_source' WHEN subtype_code = 'package' AND product_type = 'mortgage' THEN 'ambiguous_product_boundary' WHEN regexp_matches(product_name, '^(?:see|view|check)\\b') OR contains(codes, 'invalid_numeric_range') THEN 'suspect_fields'
  WHEN contains(codes, 'required_field_missing') THEN 'missing_fields' WHEN validation_status = 'error' THEN 'validation_error' ELSE 'evidence_review' END AS category FROM v""", "product"))  # fmt: skip
def review_diagnosis(spark, sf_dir):
    """What a reviewer should look at first, and what to do."""
    name, codes = F.col("product_name"), F.col("codes")
    return candidates(spark, sf_dir).select("product_id", quality.first_match([
        ((F.col("product_family") == "lending") & (F.col("product_type") == "personal-loan"), "non_product_source"), ((F.col("subtype_code") == "package") & (F.col("product_type") == "mortgage"), "ambiguous_product_boundary"),
        (name.rlike(r"^(?:see|view|check)\b") | F.array_contains(codes, "invalid_numeric_range"), "suspect_fields"), (F.array_contains(codes, "required_field_missing"), "missing_fields"), (F.col("validation_status") == "error", "validation_error"),
    ], "evidence_review").alias("category"))


@query(sql(f"""
WITH {CANDIDATES}, s AS (SELECT product_id, min(note) AS role, count(*) AS n FROM version GROUP BY 1)
SELECT product_id, CASE WHEN regexp_matches(codes, 'invalid_taxonomy_code|invalid_term_value') THEN 'force_review_issue_code' WHEN contains(codes, 'required_field_missing') THEN 'comparison_fields_missing' WHEN product_type = 'personal-loan' AND coalesce(n, 0) < 28 THEN 'ai_grounding_insufficient' WHEN role IS NULL THEN 'source_role_missing'
  WHEN role <> 'A' THEN 'non_detail_source_role' WHEN status <> 'active' THEN 'non_product_source' WHEN subtype_code IS NULL THEN 'ambiguous_product_boundary' WHEN regexp_matches(lower(product_name), 'compare|calculator|rose') THEN 'non_product_name' END AS skip_reason FROM v LEFT JOIN s USING (product_id)""", "product", "version"))  # fmt: skip
def promotion_gates(spark, sf_dir):
    """The first gate that keeps a candidate from being promoted, or none."""
    sources = read(spark, sf_dir, "version").groupBy("product_id").agg(F.min("note").alias("role"), F.count("*").alias("n"))
    has = lambda code: F.array_contains("codes", code)
    df = candidates(spark, sf_dir).join(sources, "product_id", "left")
    return df.select("product_id", quality.first_match([
        (has("invalid_taxonomy_code") | has("invalid_term_value"), "force_review_issue_code"), (has("required_field_missing"), "comparison_fields_missing"), ((F.col("product_type") == "personal-loan") & (F.coalesce("n", F.lit(0)) < 28), "ai_grounding_insufficient"),
        (F.col("role").isNull(), "source_role_missing"), (F.col("role") != "A", "non_detail_source_role"), (F.col("status") != "active", "non_product_source"), (F.col("subtype_code").isNull(), "ambiguous_product_boundary"), (F.lower("product_name").rlike("compare|calculator|rose"), "non_product_name"),
    ]).alias("skip_reason"))


@query(sql("""
WITH f AS (SELECT product_id, note AS field, max(CASE WHEN rate_value > 30 THEN 1 ELSE 0 END) AS verified FROM version GROUP BY 1, 2), g AS (SELECT product_id, count(*) AS n, sum(verified) AS v, max(CASE WHEN field = 'N' THEN verified ELSE 0 END) AS named FROM f GROUP BY 1)
SELECT product_id, round(CAST(v AS DOUBLE) / n, 6) AS verified_ratio, concat_ws(',', CASE WHEN named = 0 THEN 'product_identity_unverified' END, CASE WHEN v < 2 THEN 'verified_field_count_below_minimum' END, CASE WHEN CAST(v AS DOUBLE) / n < 0.8 THEN 'verified_field_ratio_below_threshold' END) AS reason_codes FROM g""", "version"))  # fmt: skip
def grounding_assessment(spark, sf_dir):
    """Whether enough of a candidate's fields, its name among them, are verified by official evidence."""
    fields = read(spark, sf_dir, "version").groupBy("product_id", F.col("note").alias("field")).agg(F.max(F.col("rate_value") > 30).alias("verified"))
    return gates.grounding(fields, "product_id", "N", 0.8)


@query(sql("""
SELECT product_id, CASE product_type WHEN 'savings' THEN CASE WHEN country_code NOT IN ('CA', 'US') AND tags IS NULL THEN 'foreign_currency' WHEN regexp_matches(lower(product_name), 'premium|high interest|hisa|gold') THEN 'high_interest' WHEN contains(coalesce(tags, ''), 'student') OR contains(coalesce(tags, ''), 'youth') THEN 'youth' ELSE 'standard' END
  WHEN 'chequing' THEN CASE WHEN coalesce(direct_rate, posted_rate) > 0 THEN 'interest_bearing' WHEN regexp_matches(lower(product_name), 'premium|vip|ultimate|signature|all-inclusive|all inclusive') THEN 'premium' WHEN minimum_balance >= 2500 THEN 'package' ELSE 'standard' END
  WHEN 'gic' THEN CASE WHEN regexp_matches(lower(product_name), 'market.linked|index.linked|equity.linked') THEN 'market_linked' WHEN term_length_days >= 1000 THEN 'non_redeemable' WHEN term_length_days >= 300 THEN 'redeemable' ELSE 'other' END ELSE 'other' END AS subtype,
  concat_ws(',', CASE WHEN contains(coalesce(tags, ''), 'student') OR contains(coalesce(tags, ''), 'youth') THEN 'student' END, CASE WHEN contains(coalesce(tags, ''), 'newcomer') THEN 'newcomer' END, CASE WHEN contains(coalesce(tags, ''), 'senior') THEN 'senior' END) AS customers,
  concat_ws('; ', 'Stored as percentage points', CASE WHEN term_length_days IS NOT NULL THEN 'term-specific rates are listed separately' END, CASE WHEN product_type = 'savings' AND monthly_fee IS NULL THEN 'interest paid monthly' END) || '.' AS rate_note,
  CASE WHEN minimum_deposit IS NOT NULL THEN 'Minimum deposit in ' || CASE country_code WHEN 'CA' THEN 'CAD' WHEN 'US' THEN 'USD' WHEN 'JP' THEN 'JPY' WHEN 'KR' THEN 'KRW' ELSE 'XXX' END || '.' END AS deposit_note,
  CASE country_code WHEN 'CA' THEN 'CAD' WHEN 'US' THEN 'USD' WHEN 'JP' THEN 'JPY' WHEN 'KR' THEN 'KRW' ELSE 'XXX' END AS currency FROM product""", "product"))  # fmt: skip
def assembled_candidates(spark, sf_dir):
    """Candidates as they are assembled: currency by country, subtype by the type's rules, customers, notes on figures."""
    return gates.assembled(read(spark, sf_dir, "product")).select("product_id", "subtype", F.array_join("customers", ",").alias("customers"), "rate_note", "deposit_note", "currency")
