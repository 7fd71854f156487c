"""Comparison requirements by precedence, on payloads made by hand."""

import json

from quarrystone.operators import profiles

US_SAVINGS = {"standard_rate": 4.1, "monthly_fee": 0, "minimum_deposit": 100}


CASES = [
    ("CA", "savings", {"standard_rate": 2, "monthly_fee": 0, "minimum_balance": 0}, [], ("*", True, True, True, ["standard_rate", "monthly_fee", "minimum_balance"], [])),
    (None, "Savings", {"standard_rate": 2, "monthly_fee": 0, "minimum_deposit": 0}, [], ("*", True, True, False, ["standard_rate", "monthly_fee"], ["minimum_balance"])),
    ("us ", "savings", US_SAVINGS, [], ("US", True, True, True, ["standard_rate", "monthly_fee", "minimum_deposit"], [])),
    ("US", "savings", US_SAVINGS | {"monthly_fee": "$5"}, [], ("US", True, True, False, ["standard_rate", "monthly_fee", "minimum_deposit"], ["fee_waiver_condition"])),
    ("CA", "savings", {"public_display_rate": 5, "promotional_rate": 5, "monthly_fee": 0, "minimum_balance": 1}, [], ("*", True, True, False, ["monthly_fee", "minimum_balance"], ["standard_rate"])),
    ("CA", "savings", {"public_display_rate": 5, "promotional_rate": "", "monthly_fee": 0, "minimum_balance": 1}, [], ("*", True, True, True, ["public_display_rate", "monthly_fee", "minimum_balance"], [])),
    ("CA", "savings", {"base_12_month_rate": 5, "promotional_rate": 5, "monthly_fee": 0, "minimum_balance": 1}, [], ("*", True, True, True, ["base_12_month_rate", "monthly_fee", "minimum_balance"], [])),
    ("JP", "savings", US_SAVINGS, [], (None, True, False, False, [], [])),
    ("CA", "", {}, [], (None, False, True, True, [], [])),
    ("CA", "chequing", {"monthly_fee": 0, "unlimited_transactions_flag": True}, [], ("*", True, True, True, ["monthly_fee", "unlimited_transactions_flag"], [])),
    ("CA", "chequing", {"monthly_fee": 4, "unlimited_transactions_flag": "true", "included_transactions": None}, [], ("*", True, True, False, ["monthly_fee"], ["minimum_balance", "included_transactions"])),
    ("CA", "gic", {"term_rate_table": [{"rate": 4, "term_label": "1 year"}], "minimum_deposit": 1, "redeemable_flag": False}, [], ("*", True, True, True, ["term_rate_table", "term_rate_table", "minimum_deposit", "redeemable_flag"], [])),
    ("CA", "gic", {"term_rate_table": [{"rate": 4}], "minimum_deposit": 1, "redeemable_flag": "yes"}, [], ("*", True, True, False, ["minimum_deposit"], ["standard_rate", "term_length_text", "redeemable_flag"])),
    ("CA", "mortgage", {"interest_rate_summary": "ask us", "mortgage_rate": "4.5%", "rate_type": "fixed", "term_length_text": "5 years"}, [], ("*", True, True, True, ["mortgage_rate", "rate_type", "term_length_text"], [])),
    ("US", "mortgage", {"interest_rate_summary": "APR of 6.5%", "rate_type": "fixed", "term_length_text": "5 years"}, [], ("US", True, True, True, ["interest_rate_summary", "rate_type", "term_length_text"], [])),
    ("CA", "new", {"new_rate": 4, "new_fee": 0}, ["new_rate", "new_fee", "notes"], (None, True, True, True, ["new_rate", "new_fee"], [])),
    ("CA", "new", {"new_rate": "soon", "new_fee": 0}, ["new_rate", "new_fee"], (None, True, True, False, ["new_fee"], ["new_rate"])),
    ("JP", "new", {"new_rate": 4}, ["new_rate", "notes"], (None, True, False, False, [], [])),
    ("CA", "credit-card", "no json", [], ("*", True, True, False, [], ["annual_fee", "purchase_interest_rate"])),
    ("CA", "credit-card", None, None, ("*", True, True, False, [], ["annual_fee", "purchase_interest_rate"])),
]


def test_quality(spark):
    text = lambda payload: payload if payload is None or isinstance(payload, str) else json.dumps(payload)
    df = spark.createDataFrame([(n, c, t, text(p), e) for n, (c, t, p, e, _) in enumerate(CASES)], "n int, country_code string, product_type string, payload string, expected array<string>")
    got = {r.n: (r.profile, r.applicable, r.contract_defined, r.complete, r.satisfied, r.missing) for r in profiles.quality(df, "payload", "expected").collect()}
    assert [got[n] for n in range(len(CASES))] == [c[4] for c in CASES]
