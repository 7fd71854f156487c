"""Validation of candidates: codes of what is wrong, from the record, its payload, its evidence and notes.

A payload is JSON whose values keep their types (VARIANT). Everything is decided inside the
row; the requirements of the market come from ``profiles.quality``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import contracts, rates
from quarrystone.functions import text as tx
from quarrystone.operators import gates, profiles

# Bounds from which on figures aren't believed.
ANNUAL_RATE, OTHER_RATE, HIGHEST_RATE, FEE, CARD_FEE, STALE_YEARS = 10, 100, 100, 500, 2000, 5
DEPOSITS = ("chequing", "savings", "gic")
ANNUAL = ("standard_rate", "base_12_month_rate", "promotional_rate", "public_display_rate")
BOUNDARIES = ("multi_product_family_overview", "hub_page_not_detail")
PARTIAL = ("partial", "source failure", "no evidence-linked", "no grounded", "insufficient grounded", "without any specific product")
EQUITY_LINES = ("home equity line of credit", "heloc")
# The subtypes of each type.
TAXONOMY = {
    "chequing": ("standard", "package", "interest_bearing", "premium", "other"), "savings": ("standard", "high_interest", "youth", "foreign_currency", "other"), "gic": ("redeemable", "non_redeemable", "market_linked", "other"),
    "credit-card": ("standard", "premium", "other"), "mortgage": ("fixed", "variable", "other"), "personal-loan": ("standard", "other"), "line-of-credit": ("standard", "other"),
}
# Assumptions of a rate, one of each group, that a summary has to keep where its evidence states them.
SCENARIOS = {
    "mortgage": (("down payment",), ("loan of $", "loan amount"), ("purchase transaction", "refinance transaction"), ("day lock", "rate lock"), ("ltv", "loan-to-value", "loan to value"), ("fico", "credit score"), ("owner-occupied", "owner occupied", "occupancy"), ("discount point", "points"), ("rates change daily", "rate may change", "rate can change")),
    "personal-loan": (("ltv", "loan-to-value", "loan to value"), ("down payment",), ("credit history", "credit profile", "credit score", "excellent credit"), ("model year", "vehicle age"), ("origination fee",), ("relationship discount", "autopay discount", "automatic payment discount", "auto deduct discount"), ("automatic payments", "automatic payment", "autopay", "auto pay", "auto deduct"), ("qualifying checking", "qualifying deposit account", "qualifying account"), ("existing customer", "existing bank customer"), ("rates are subject to change", "rate may change", "rate can change")),
    "savings": (("only available on new", "new savings account", "do not have an existing", "within the past 30 days"), ("within 30 days",), ("balance of at least", "minimum daily balance"), ("standard interest rate will be applied", "standard rate will apply"), ("apy shown is accurate as of", "rates as of", "rate is accurate as of"), ("rate is variable", "variable and may change", "subject to change")),
}
CODES = ("ambiguous_mapping", "ambiguous_product_boundary", "conflicting_evidence", "inconsistent_cross_field_logic", "invalid_field_type", "invalid_numeric_range", "invalid_taxonomy_code", "invalid_term_value", "partial_source_failure", "required_field_missing")
#: Codes that are errors; the others are warnings.
ERRORS = ("conflicting_evidence", "inconsistent_cross_field_logic", "invalid_field_type", "invalid_numeric_range", "invalid_taxonomy_code", "invalid_term_value", "required_field_missing")


def _is(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _none(x: Column) -> Column:
    return _is(x.isNull() | (F.trim(x) == ""))


class Payload:
    """Values of a VARIANT map column by field."""

    def __init__(self, column: str):
        self.map = F.col(column)

    def value(self, field: str) -> Column:
        return F.try_element_at(self.map, F.lit(field))

    def text(self, field: str) -> Column:
        return self.value(field).try_cast("string")

    def number(self, field: str) -> Column:
        return contracts.decimal(F.lit(field), self.text(field))

    def flag(self, field: str) -> Column:
        return F.when(contracts.kind_of_variant(self.value(field)) == "boolean", self.value(field).try_cast("boolean"))

    def any(self, test) -> Column:
        """Whether ``test(field, value)`` holds for any field that says something."""
        return _is(F.exists(F.map_entries(self.map), lambda e: profiles.populated(e["value"]) & _is(test(e["key"], e["value"]))))


def out_of_range(family: Column):
    """A test of one field: figures that can't be read, or lie outside their bounds."""

    def test(field: Column, value: Column) -> Column:
        n, unit = contracts.decimal(field, value.try_cast("string")), contracts.unit(field)
        rate, fee = unit == "percentage_points", (unit == "currency_amount") & field.endswith("_fee")
        annual = rate & (field.isin(*ANNUAL) | family.isin(*DEPOSITS)) & (field != "highest_rate")
        bad = (
            F.when(field == "highest_rate", ~n.between(0, HIGHEST_RATE)).when(annual, (n < 0) | (n >= ANNUAL_RATE)).when(rate, n >= OTHER_RATE)
            .when(fee, (n < 0) | (n >= F.when(field == "annual_fee", CARD_FEE).otherwise(FEE))).otherwise(n < 0)
        )
        return (contracts.value_type(field) == "decimal") & (n.isNull() | _is(bad))

    return test


def cross_field(p: Payload, family: Column, country: Column, name: Column, evidence: Column, day: Column) -> Column:
    """Fields that contradict each other."""
    shown, standard, promo = p.number("public_display_rate"), p.number("standard_rate"), p.number("promotional_rate")
    table = F.exists(p.value("term_rate_table").try_cast("array<map<string, variant>>"), lambda r: contracts.decimal(F.lit("standard_rate"), F.try_element_at(r, F.lit("rate")).try_cast("string")) > shown)
    total = F.coalesce(*(rates.promotional_total(rates.context(p.text(f)), day) for f in ("interest_rate_summary", "promotional_period_text")))
    fee, shown_fee = p.number("monthly_fee"), p.number("public_display_fee")
    waived = F.regexp_replace(F.nullif(F.regexp_extract(F.lower(p.text("fee_waiver_condition")), r"with a \$?([0-9][0-9,]*(?:\.[0-9]{1,2})?) minimum balance", 1), F.lit("")), ",", "").try_cast("double")
    chequing = [
        fee != shown_fee, waived.isNotNull() & ~waived.eqNullSafe(p.number("minimum_balance")), name.rlike("no[- ]fee") & _is((fee > 0) | (shown_fee > 0)),
        (F.lower(p.text("unlimited_transactions_flag")) == "true") & (tx.number(p.text("included_transactions")) > 0),
    ]
    kept = {kind: gates.preserved(p.text("interest_rate_summary"), F.array_join(F.transform(evidence, lambda e: F.coalesce(e["excerpt"], F.lit(""))), " "), [list(g) for g in groups]) for kind, groups in SCENARIOS.items()}
    lost = reduce(lambda a, b: a | b, [(family == kind) & ~test for kind, test in kept.items()])
    stale = F.exists(evidence, lambda e: (contracts.unit(e["field"]) == "percentage_points") & (gates.as_of(e["excerpt"]) < F.add_months(day, -12 * STALE_YEARS)))
    tests = [
        (shown < standard) | _is(shown < promo), shown < promo, (family == "gic") & table, (promo != total) | _is(shown != total), shown != total, *[(family == "chequing") & t for t in chequing],
        p.flag("redeemable_flag") == p.flag("non_redeemable_flag"), (family == "gic") & profiles.populated(p.value("minimum_balance")) & ~profiles.populated(p.value("minimum_deposit")),
        (country == "US") & lost, stale,
    ]
    return reduce(lambda a, b: a | b, map(_is, tests))


def issues(candidates: DataFrame, day: Column) -> DataFrame:
    """``candidates`` with codes (sorted) and validation_status.

    Columns: country_code, bank_code, product_family, product_type, product_name, subtype_code,
    currency, source_language, payload (JSON), expected and notes and reasons (lists of text), and
    evidence (a list of field, value, excerpt). Null lists are empty.
    """
    texts, links = "array<string>", "array<struct<field: string, value: string, excerpt: string>>"
    df = candidates
    for name, kind in (("expected", texts), ("notes", texts), ("reasons", texts), ("evidence", links)):
        df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    df = profiles.quality(df, "payload", "expected").withColumn("_map", F.coalesce(F.try_parse_json("payload").try_cast("map<string, variant>"), F.create_map().cast("map<string, variant>")))
    p, c = Payload("_map"), F.col
    family, country, name = F.lower(F.trim(F.coalesce("product_type", F.lit("")))), F.upper(F.trim(F.coalesce("country_code", F.lit("")))), F.lower(F.coalesce("product_name", p.text("product_name"), F.lit("")))
    linked = F.transform(F.filter("evidence", lambda e: (F.trim(e["field"]) != "") & (F.trim(e["value"]) != "")), lambda e: F.trim(e["field"]))
    identity = reduce(lambda a, b: a | b, [_none(c(x)) for x in ("country_code", "bank_code", "product_family", "product_type", "product_name", "currency")] + [_none(p.text("status"))])
    verified = F.try_to_timestamp(p.text("last_verified_at")).isNotNull()
    unlinked = F.size(F.array_except(F.array_union(F.array(F.lit("product_name")), "satisfied"), linked)) > 0
    incomplete = c("applicable") & (~c("contract_defined") | ~c("complete") | unlinked)
    known = reduce(lambda a, b: a | b, [(family == kind) & (_none(c("subtype_code")) | _is(c("subtype_code").isin(*subtypes))) for kind, subtypes in TAXONOMY.items()])
    days = tx.number(p.text("term_length_days"))
    assessed = F.array_union(F.array(F.lit("product_name")), F.array_union("satisfied", "missing"))
    values = lambda f: F.array_distinct(F.transform(F.filter("evidence", lambda e: e["field"] == f), lambda e: F.trim(e["value"])))
    noted = F.lower(F.array_join("notes", " "))
    tests = {
        "ambiguous_mapping": ~_none(c("source_language")) & ~_is(c("source_language").rlike("^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$")),
        "ambiguous_product_boundary": F.arrays_overlap(F.transform("reasons", lambda r: F.lower(F.trim(r))), F.array(*map(F.lit, BOUNDARIES))),
        "conflicting_evidence": F.exists(assessed, lambda f: F.size(values(f)) > 1),
        "inconsistent_cross_field_logic": cross_field(p, family, country, name, c("evidence"), day),
        "invalid_field_type": F.exists(F.map_entries("_map"), lambda e: ~contracts.fits(contracts.value_type(e["key"]), contracts.kind_of_variant(e["value"]))),
        "invalid_numeric_range": p.any(out_of_range(family)),
        "invalid_taxonomy_code": ~_is(known) | ((family == "mortgage") & name.rlike("|".join(EQUITY_LINES))),
        "invalid_term_value": profiles.populated(p.value("term_length_days")) & ~_is((days == F.floor(days)) & (days >= 1)),
        "partial_source_failure": noted.rlike("|".join(PARTIAL)),
        "required_field_missing": identity | ~verified | incomplete,
    }
    codes = F.array_compact(F.array(*[F.when(_is(tests[code]), code) for code in CODES]))
    out = df.withColumn("codes", codes)
    status = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, ERRORS))), "error").when(F.size("codes") > 0, "warning").otherwise("pass")
    return out.withColumn("validation_status", status).select(*candidates.columns, "codes", "validation_status")
