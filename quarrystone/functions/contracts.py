"""What type a product field has, values brought to it, and values that break it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import rates
from quarrystone.functions import text as tx

# The fields of each type. A field that ends in _flag is a boolean, one in _rate or _fee a decimal, unless it is listed.
STRINGS = (
    "product_name", "description_short", "fee_waiver_condition", "promotional_period_text", "eligibility_text", "application_method", "post_maturity_interest_rate", "tax_benefits", "deposit_insurance",
    "term_length_text", "interest_calculation_method", "interest_payment_frequency", "tier_definition_text", "withdrawal_limit_text", "compounding_frequency", "payout_option", "cheque_book_info", "notes",
    "interest_rate_summary", "purchase_interest_rate_summary", "rate_type", "amortization_text", "payment_frequency", "prepayment_privileges", "rewards_summary", "credit_limit_text", "loan_amount_text",
    "monthly_payment_text", "security_requirement", "collateral_text", "minimum_payment_text", "fees_text", "early_withdrawal_penalty",
)
DECIMALS = (
    "monthly_fee", "public_display_fee", "minimum_balance", "minimum_deposit", "standard_rate", "base_12_month_rate", "promotional_rate", "public_display_rate", "highest_rate", "annual_fee", "purchase_interest_rate",
    "cash_advance_rate", "balance_transfer_rate", "mortgage_rate", "interest_rate",
)
MONEY = ("monthly_fee", "public_display_fee", "minimum_balance", "minimum_deposit", "annual_fee")
INTEGERS = ("term_length_days", "included_transactions")
BOOLEANS = ("registered_plan_supported", "interac_e_transfer_included", "overdraft_available")
STRUCTURED = ("term_rate_table",)


def value_type(field: Column) -> Column:
    """string, decimal, integer, boolean or json; null for a field without a contract."""
    name = F.lower(F.trim(field))
    return (
        F.when(name.isin(*STRINGS), "string").when(name.isin(*INTEGERS), "integer").when(name.isin(*BOOLEANS) | name.endswith("_flag"), "boolean")
        .when(name.isin(*STRUCTURED), "json").when(name.isin(*DECIMALS) | name.endswith("_rate") | name.endswith("_fee"), "decimal")
    )


def unit(field: Column) -> Column:
    name, kind = F.lower(F.trim(field)), value_type(field)
    return (
        F.when((kind == "decimal") & (name.isin(*MONEY) | name.endswith("_fee")), "currency_amount").when(kind == "decimal", "percentage_points")
        .when(name == "term_length_days", "days").when(kind == "integer", "count").when(kind == "json", "structured_rows")
    )


def decimal(field: Column, value: Column) -> Column:
    """The number of '4.49%', '$1,200.50' or '7'; no fee in words is zero, for fees."""
    low = F.lower(F.trim(value))
    words = (unit(field) == "currency_amount") & low.rlike("^(no|zero|free)( monthly| annual)?( fees?)?$")
    return F.when(words, F.lit(0.0)).otherwise(tx.number(low))


ROWS = "array<struct<term_label: string, term_length_days: int, rate: string>>"


def rate_rows(value: Column) -> Column:
    """(days, rate) rows of a table that is JSON, or else spelt out; days by their label where no number is given."""
    read = F.from_json(value, ROWS)
    each = F.transform(read, lambda r: F.struct(F.coalesce(r["term_length_days"], tx.term_days(r["term_label"])).alias("days"), tx.number(r["rate"]).alias("rate")))
    found = F.array_distinct(F.filter(each, lambda r: r["rate"].isNotNull()))
    spelt = rates.rate_table(value)
    return F.when(F.trim(value).startswith("["), found).otherwise(F.when(F.size(spelt) > 0, spelt))


def normalized(field: Column, value: Column) -> Column:
    """The value as its field's type has it: one of text, number, whole, flag and rows is set; none where it can't be read."""
    kind, given = F.coalesce(value_type(field), F.lit("string")), F.nullif(F.trim(value), F.lit(""))
    whole = tx.number(given)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "string", given).alias("text"),
        F.when(kind == "decimal", decimal(field, given)).alias("number"),
        F.when((kind == "integer") & (whole == F.floor(whole)), whole.cast("bigint")).alias("whole"),
        F.when(kind == "boolean", F.lower(given) == "true").alias("flag"),
        F.when(kind == "json", rate_rows(given)).alias("rows"),
    )


def kind_of_variant(value: Column) -> Column:
    """What a VARIANT value is: string, integer, decimal, boolean, json or null."""
    schema = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value), "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").when(schema == "BIGINT", "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal").otherwise("json")
    )


def fits(kind: Column, found: Column) -> Column:
    """Whether a value of kind ``found`` keeps a contract of type ``kind``: no contract and no value break nothing, a whole number is a decimal too."""
    return kind.isNull() | (found == "null") | (found == kind) | ((kind == "decimal") & (found == "integer"))
