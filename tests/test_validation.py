"""Codes of validation: a sound candidate, and what each change of it brings up."""

import json

from pyspark.sql import functions as F

from quarrystone.operators import validation

RECORD = {"country_code": "CA", "bank_code": "B", "product_family": "deposit", "product_type": "savings", "product_name": "Harbour", "subtype_code": "standard", "currency": "CAD", "source_language": "en", "expected": None, "notes": None, "reasons": None}
PAYLOAD = {"status": "active", "last_verified_at": "2026-04-01T00:00:00Z", "standard_rate": 2.5, "monthly_fee": 0, "minimum_balance": 0}
LINKS = {"product_name": "Harbour", "standard_rate": "2.5", "monthly_fee": "0", "minimum_balance": "0"}
CHEQUING = {"product_type": "chequing"}
GIC_PAYLOAD = {"status": "active", "last_verified_at": "2026-04-01", "standard_rate": 3, "term_length_days": 365, "minimum_deposit": 1, "redeemable_flag": True}
GIC_LINKS = {"product_name": "G", "standard_rate": "3", "term_length_days": "365", "minimum_deposit": "1", "redeemable_flag": "true"}
US_MORTGAGE = {"country_code": "US", "product_type": "mortgage", "subtype_code": "fixed"}
US_PAYLOAD = {"status": "active", "last_verified_at": "2026-04-01", "interest_rate_summary": "APR of 6.5%", "rate_type": "fixed", "term_length_text": "30 years"}
US_LINKS = {"product_name": "M", "interest_rate_summary": "APR of 6.5%", "rate_type": "fixed", "term_length_text": "30 years"}
SCHEMA = "n int, country_code string, bank_code string, product_family string, product_type string, product_name string, subtype_code string, currency string, source_language string, expected array<string>, notes array<string>, reasons array<string>, payload string, evidence array<struct<field: string, value: string, excerpt: string>>"
#: (changes of the record, payload, evidence as field: value or [(field, value, excerpt)], codes)
CASES = [
    ({}, PAYLOAD, LINKS, []),
    ({"currency": " "}, PAYLOAD, LINKS, ["required_field_missing"]),
    ({}, PAYLOAD | {"last_verified_at": "soon"}, LINKS, ["required_field_missing"]),
    ({}, PAYLOAD | {"minimum_balance": None}, LINKS, ["required_field_missing"]),
    ({}, PAYLOAD, {k: v for k, v in LINKS.items() if k != "monthly_fee"}, ["required_field_missing"]),
    ({"country_code": "JP"}, PAYLOAD, LINKS, ["required_field_missing"]),
    ({"subtype_code": "fixed"}, PAYLOAD, LINKS, ["invalid_taxonomy_code"]),
    ({"subtype_code": None}, PAYLOAD, LINKS, []),
    ({"product_type": "unheard-of"}, PAYLOAD, LINKS, ["invalid_taxonomy_code", "required_field_missing"]),
    ({"source_language": "english!"}, PAYLOAD, LINKS, ["ambiguous_mapping"]),
    ({"source_language": "fr-CA"}, PAYLOAD, LINKS, []),
    ({"reasons": ["x", " Hub_Page_Not_Detail"]}, PAYLOAD, LINKS, ["ambiguous_product_boundary"]),
    ({"notes": ["A Partial read"]}, PAYLOAD, LINKS, ["partial_source_failure"]),
    ({}, PAYLOAD | {"standard_rate": 10}, LINKS, ["invalid_numeric_range"]),
    ({}, PAYLOAD | {"standard_rate": -0.1}, LINKS, ["invalid_numeric_range"]),
    ({}, PAYLOAD | {"highest_rate": 15}, LINKS, []),
    ({}, PAYLOAD | {"monthly_fee": 500}, LINKS, ["invalid_numeric_range"]),
    ({}, PAYLOAD | {"monthly_fee": 499.5}, LINKS, []),
    ({}, PAYLOAD | {"minimum_balance": -5}, LINKS, ["invalid_numeric_range"]),
    ({}, PAYLOAD | {"teller_fee": "lots"}, LINKS, ["invalid_field_type", "invalid_numeric_range"]),
    ({}, PAYLOAD | {"notes": 5}, LINKS, ["invalid_field_type"]),
    ({}, PAYLOAD | {"term_length_days": 0}, LINKS, ["invalid_term_value"]),
    ({}, PAYLOAD | {"term_length_days": 1.5}, LINKS, ["invalid_field_type", "invalid_term_value"]),
    ({}, PAYLOAD, [*[(k, v, None) for k, v in LINKS.items()], ("standard_rate", "2.75", None)], ["conflicting_evidence"]),
    ({}, PAYLOAD, [*[(k, v, None) for k, v in LINKS.items()], ("notes", "a", None), ("notes", "b", None), ("standard_rate", " 2.5", None)], []),
    ({}, PAYLOAD, [*[(k, v, None) for k, v in LINKS.items()], ("standard_rate", "2.5", "Rates as of 2021-04-12")], ["inconsistent_cross_field_logic"]),
    ({}, PAYLOAD, [*[(k, v, None) for k, v in LINKS.items()], ("standard_rate", "2.5", "Rates as of 2021-04-14")], []),
    ({}, PAYLOAD | {"public_display_rate": 2}, LINKS, ["inconsistent_cross_field_logic"]),
    ({}, PAYLOAD | {"public_display_rate": 5, "promotional_rate": 6}, LINKS, ["inconsistent_cross_field_logic"]),
    ({}, PAYLOAD | {"public_display_rate": 5, "promotional_rate": 5, "promotional_period_text": "Special offer: earn 4.5% for 6 months"}, LINKS, ["inconsistent_cross_field_logic"]),
    ({}, PAYLOAD | {"public_display_rate": 4.5, "promotional_rate": 4.5, "promotional_period_text": "Special offer: earn 4.5% for 6 months"}, LINKS, []),
    (CHEQUING, PAYLOAD | {"public_display_fee": 1, "included_transactions": 3}, LINKS | {"included_transactions": "3"}, ["inconsistent_cross_field_logic"]),
    (CHEQUING, PAYLOAD | {"included_transactions": 3, "fee_waiver_condition": "Waived with a 4,000 minimum balance", "minimum_balance": 4000}, LINKS | {"included_transactions": "3"}, []),
    (CHEQUING, PAYLOAD | {"included_transactions": 3, "fee_waiver_condition": "Waived with a 4,000 minimum balance"}, LINKS | {"included_transactions": "3"}, ["inconsistent_cross_field_logic"]),
    (CHEQUING | {"product_name": "No-Fee Banking"}, PAYLOAD | {"included_transactions": 3, "monthly_fee": 2}, LINKS | {"included_transactions": "3"}, ["inconsistent_cross_field_logic"]),
    (CHEQUING, PAYLOAD | {"included_transactions": 3, "unlimited_transactions_flag": True}, LINKS | {"included_transactions": "3"}, ["inconsistent_cross_field_logic"]),
    ({"product_type": "gic", "subtype_code": "other"}, GIC_PAYLOAD, GIC_LINKS, []),
    ({"product_type": "gic", "subtype_code": "other"}, GIC_PAYLOAD | {"non_redeemable_flag": True}, GIC_LINKS, ["inconsistent_cross_field_logic"]),
    ({"product_type": "gic", "subtype_code": "other"}, GIC_PAYLOAD | {"public_display_rate": 3, "term_rate_table": [{"rate": "3.5%", "term_label": "1 year"}]}, GIC_LINKS, ["inconsistent_cross_field_logic"]),
    (US_MORTGAGE, US_PAYLOAD, US_LINKS, []),
    (US_MORTGAGE, US_PAYLOAD, [*[(k, v, "With a down payment of 20%") for k, v in US_LINKS.items()]], ["inconsistent_cross_field_logic"]),
    (US_MORTGAGE, US_PAYLOAD | {"interest_rate_summary": "APR of 6.5% with a down payment of 20%"}, [*[(k, v, "With a down payment of 20%") for k, v in US_LINKS.items()]], []),
    (US_MORTGAGE | {"product_name": "Our HELOC"}, US_PAYLOAD, US_LINKS, ["invalid_taxonomy_code"]),
    ({}, "no json", LINKS, ["required_field_missing"]),
    ({}, None, None, ["required_field_missing"]),
]


def test_codes(spark):
    rows = []
    for n, (changes, payload, evidence, _) in enumerate(CASES):
        links = evidence if evidence is None or isinstance(evidence, list) else [(k, v, None) for k, v in evidence.items()]
        rows.append((n, *(RECORD | changes).values(), payload if payload is None or isinstance(payload, str) else json.dumps(payload), links))
    found = {r.n: r for r in validation.issues(spark.createDataFrame(rows, SCHEMA), F.lit("2026-04-13").cast("date")).collect()}
    assert [(n, found[n].codes) for n in range(len(CASES))] == [(n, c[3]) for n, c in enumerate(CASES)]
    assert all(r.validation_status == ("pass" if not r.codes else "error" if set(r.codes) & set(validation.ERRORS) else "warning") for r in found.values())
    assert {c for case in CASES for c in case[3]} == set(validation.CODES)
