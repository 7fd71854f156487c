"""What a comparison asks of a product in its market: rules found by precedence, values that can meet them, what is missing.

The rules are a short table in the code. A product takes those of its country and type; where
there are none, and the country is Canada or not named, those of the baseline; else none. The
table is joined twice on equality and never grows with the products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import contracts, rates

BASELINE, AT_HOME = "*", ("", "CA")
#: A requirement that counts only where a monthly fee is above zero.
WITH_FEE = "positive_monthly_fee"
_ONGOING = ("standard_rate", "base_12_month_rate", "public_display_rate")
_SCHEDULE = (*_ONGOING, "highest_rate", "interest_rate_summary", "term_rate_table")
_FEE, _TERM, _SECURITY = ("monthly_fee", "public_display_fee"), ("term_length_text", "term_length_days", "term_rate_table"), ("security_requirement", "secured_flag", "collateral_text")
# Requirements of each country and type, as (name, fields that can meet it, best first, when it counts).
PROFILES = {
    (BASELINE, "chequing"): (("monthly_fee", _FEE, None), ("minimum_balance", ("minimum_balance", "fee_waiver_condition"), WITH_FEE), ("transactions", ("included_transactions", "unlimited_transactions_flag", "transaction_fee", "additional_transaction_fee"), None)),
    (BASELINE, "savings"): (("ongoing_rate", _ONGOING, None), ("monthly_fee", _FEE, None), ("minimum_balance", ("minimum_balance",), None)),
    (BASELINE, "gic"): (("rate", _SCHEDULE, None), ("term", _TERM, None), ("minimum_deposit", ("minimum_deposit",), None), ("redeemability", ("redeemable_flag", "non_redeemable_flag"), None)),
    (BASELINE, "credit-card"): (("annual_fee", ("annual_fee",), None), ("purchase_rate", ("purchase_interest_rate",), None)),
    (BASELINE, "mortgage"): (("rate", ("interest_rate_summary", "mortgage_rate"), None), ("rate_type", ("rate_type",), None), ("term", ("term_length_text",), None)),
    (BASELINE, "personal-loan"): (("rate", ("interest_rate_summary", "interest_rate"), None), ("amount", ("loan_amount_text",), None), ("term", ("term_length_text",), None)),
    (BASELINE, "line-of-credit"): (("rate", ("interest_rate_summary", "interest_rate"), None), ("limit", ("credit_limit_text",), None), ("security", _SECURITY, None)),
    ("US", "chequing"): (("monthly_fee", _FEE, None), ("opening_or_minimum_balance", ("minimum_balance", "minimum_deposit"), None), ("fee_waiver_or_qualifying_activity", ("fee_waiver_condition",), WITH_FEE)),
    ("US", "savings"): (("ongoing_apy", _ONGOING, None), ("monthly_fee", _FEE, None), ("opening_or_minimum_balance", ("minimum_balance", "minimum_deposit"), None), ("fee_waiver_or_qualifying_activity", ("fee_waiver_condition",), WITH_FEE)),
    ("US", "gic"): (("apy_or_rate_schedule", _SCHEDULE, None), ("term", _TERM, None), ("minimum_opening_deposit", ("minimum_deposit",), None), ("early_withdrawal_penalty", ("early_withdrawal_penalty",), None)),
    ("US", "credit-card"): (("annual_fee", ("annual_fee",), None), ("purchase_rate", ("purchase_interest_rate_summary", "purchase_interest_rate"), None)),
    ("US", "mortgage"): (("qualified_rate_or_apr", ("interest_rate_summary",), None), ("rate_type", ("rate_type",), None), ("term", ("term_length_text",), None)),
    ("US", "personal-loan"): (("apr_or_rate_range", ("interest_rate_summary", "interest_rate"), None), ("amount_range", ("loan_amount_text",), None), ("term_range", ("term_length_text",), None)),
    ("US", "line-of-credit"): (("rate", ("interest_rate", "interest_rate_summary"), None), ("limit", ("credit_limit_text",), None), ("security", ("secured_flag", "security_requirement", "collateral_text"), None)),
}
NUMBER = r"^\s*\$?\s*[0-9][0-9,]*(\.[0-9]+)?\s*%?\s*$"


def table(spark) -> DataFrame:
    """(country, type, requirements): one row for each of ``PROFILES``."""
    rows = [(country, kind, [(n, name, list(fields), when) for n, (name, fields, when) in enumerate(own)]) for (country, kind), own in PROFILES.items()]
    return spark.createDataFrame(rows, "country string, type string, requirements array<struct<n: int, name: string, fields: array<string>, when: string>>")


def is_rate(field: Column) -> Column:
    return field.endswith("_rate") | (field == "rate") | field.endswith("_apr") | field.endswith("_apy")


def populated(value: Column) -> Column:
    """Whether a VARIANT says anything: no null, blank text, or empty list or object."""
    return F.coalesce(~F.is_variant_null(value) & ~F.trim(value.try_cast("string")).isin("", "[]", "{}"), F.lit(False))


def usable(field: Column, value: Column) -> Column:
    """Whether a VARIANT can be compared as the value of ``field``."""
    kind, text = contracts.kind_of_variant(value), value.try_cast("string")
    rows = F.exists(value.try_cast("array<map<string, variant>>"), lambda r: populated(r["rate"]) & (populated(r["term_label"]) | populated(r["term_length_days"])))
    test = (
        F.when(field == "term_rate_table", F.coalesce(rows, F.lit(False)))
        .when(field == "unlimited_transactions_flag", (kind == "boolean") & (text == "true"))
        .when(field.isin("redeemable_flag", "non_redeemable_flag"), kind == "boolean")
        .when(field.endswith("rate_summary"), rates.explicit(text))
        .when(is_rate(field) | (field == "annual_fee"), kind.isin("integer", "decimal") | ((kind == "string") & text.rlike(NUMBER)))
        .otherwise(True)
    )
    return populated(value) & F.coalesce(test, F.lit(False))


def quality(candidates: DataFrame, payload: str, expected: str) -> DataFrame:
    """``candidates`` (country_code, product_type, JSON ``payload``, ``expected`` field names) with profile, applicable, contract_defined, complete, satisfied and missing.

    A type without a name asks nothing. A known type in a country without rules, and an unknown
    one that doesn't expect a rate and another figure, fail closed. Of each requirement the first
    usable field counts, and where none is, its first field is missing. A savings account's
    headline of a promotion is no ongoing rate.
    """
    spark = candidates.sparkSession
    own = table(spark)
    exact = own.where(F.col("country") != BASELINE).toDF("_c", "_t", "_exact")
    base = own.where(F.col("country") == BASELINE).select(F.col("type").alias("_b"), F.col("requirements").alias("_base"))
    df = candidates.withColumn("_type", F.lower(F.trim(F.coalesce("product_type", F.lit(""))))).withColumn("_country", F.upper(F.trim(F.coalesce("country_code", F.lit("")))))
    df = df.join(F.broadcast(exact), (F.col("_c") == F.col("_country")) & (F.col("_t") == F.col("_type")), "left").join(F.broadcast(base), F.col("_b") == F.col("_type"), "left")
    at_home, kind = F.col("_country").isin(*AT_HOME), F.col("_type")
    given = F.coalesce(F.try_parse_json(payload).try_cast("map<string, variant>"), F.create_map().cast("map<string, variant>"))
    entries = F.map_entries(given)
    df = df.withColumn("_usable", F.transform(F.filter(entries, lambda e: usable(e["key"], e["value"])), lambda e: e["key"]))
    df = df.withColumn("_there", F.transform(F.filter(entries, lambda e: populated(e["value"])), lambda e: e["key"]))
    fee = F.coalesce(*(F.get(F.transform(F.filter(entries, lambda e: e["key"] == f), lambda e: contracts.decimal(F.lit(f), e["value"].try_cast("string"))), F.lit(0)) for f in _FEE))
    asked = F.coalesce(F.col(expected), F.array().cast("array<string>"))
    rate_fields, figures = F.filter(asked, is_rate), F.filter(asked, lambda f: ~is_rate(f) & contracts.value_type(f).isin("decimal", "integer"))
    dynamic = F.when((F.size(rate_fields) > 0) & (F.size(figures) > 0), F.array(F.struct(F.lit(0).alias("n"), F.lit("rate").alias("name"), rate_fields.alias("fields"), F.lit(None).cast("string").alias("when")), F.struct(F.lit(1).alias("n"), F.lit("figure").alias("name"), figures.alias("fields"), F.lit(None).cast("string").alias("when"))))
    unknown = F.col("_b").isNull() | (F.col("_country") == "")
    chosen = F.coalesce(F.col("_exact"), F.when(at_home, F.col("_base")), F.when((kind != "") & unknown, dynamic))
    df = df.withColumn("_asked", F.filter(chosen, lambda r: r["when"].isNull() | F.coalesce(fee > 0, F.lit(False))))
    first = lambda r: F.get(F.filter(r["fields"], lambda f: F.array_contains("_usable", f)), F.lit(0))
    promotion = lambda r, f: (kind == "savings") & (F.get(r["fields"], F.lit(0)) == "standard_rate") & (f == "public_display_rate") & F.array_contains("_there", "promotional_rate")
    df = df.withColumn("_met", F.transform("_asked", lambda r: F.struct(F.get(r["fields"], F.lit(0)).alias("wanted"), F.when(~F.coalesce(promotion(r, first(r)), F.lit(False)), first(r)).alias("field"))))
    satisfied, missing = F.array_compact(F.transform("_met", lambda m: m["field"])), F.transform(F.filter("_met", lambda m: m["field"].isNull()), lambda m: m["wanted"])
    none = F.array().cast("array<string>")
    profile = F.when(F.col("_exact").isNotNull(), F.col("_country")).when(at_home & F.col("_base").isNotNull(), BASELINE)
    out = df.withColumn("profile", profile).withColumn("applicable", kind != "").withColumn("contract_defined", (kind == "") | F.col("_asked").isNotNull())
    out = out.withColumn("satisfied", F.coalesce(satisfied, none)).withColumn("missing", F.coalesce(missing, none)).withColumn("complete", (kind == "") | (F.col("_asked").isNotNull() & (F.size("missing") == 0)))
    return out.select(*candidates.columns, "profile", "applicable", "contract_defined", "complete", "satisfied", "missing")
