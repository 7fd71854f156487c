"""Cleaning of candidate fields: each rule on a text that triggers it and on one that doesn't, types, and breaches of contracts."""

import re

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import contracts, fieldrules
from quarrystone.operators import cleaning
from quarrystone.plans import cleaning as plans

SCHEMA = "candidate_id string, family string, product_name string, field string, value string, context string"
DAY = "2026-04-13"
#: (reason, family, name, field, value, evidence); a reason of None is a value that stays.
CASES = [
    ("unresolved_placeholder", "savings", "A", "notes", "From {{rate}} on", "Notes"),
    ("unresolved_placeholder", "savings", "A", "standard_rate", "xx.xx%", "Rates"),
    ("other_product_section", "savings", "A", "monthly_fee", "5", "Our other products: monthly fee $5"),
    ("unresolved_placeholder_in_evidence", "savings", "A", "standard_rate", "4", "${rate} or 4%"),
    ("expired_promotional_offer", "savings", "A", "promotional_rate", "4", "Offer valid until March 1, 2026: 4%"),
    (None, "savings", "A", "promotional_rate", "4", "Offer valid until May 1, 2026: 4%"),
    ("non_annual_return_context", "gic", "A", "standard_rate", "3", "a full term return of 3%"),
    ("implausible_annual_deposit_rate", "savings", "A", "standard_rate", "12", "interest rate 12%"),
    (None, "credit-card", "A", "interest_rate", "22", "interest rate 22%"),
    ("promotional_evidence_of_a_standard_rate", "savings", "A", "standard_rate", "4", "Earn 4% for the first 3 months"),
    ("promotional_evidence_of_a_standard_rate", "savings", "A", "base_12_month_rate", "4", "Special rate of 4%"),
    (None, "savings", "A", "promotional_rate", "4", "Earn 4% for the first 3 months"),
    ("percentage_not_in_evidence", "savings", "A", "standard_rate", "4", "interest rate 4.25%"),
    (None, "savings", "A", "standard_rate", "4.25", "interest rate 4.25%"),
    (None, "savings", "A", "standard_rate", "0", "This account pays no interest"),
    ("audience_of_a_legal_list", "chequing", "A", "student_plan_flag", "true", "May not be available on student, youth or senior plans"),
    (None, "chequing", "A", "student_plan_flag", "true", "A plan for students"),
    ("money_that_is_no_fee", "chequing", "A", "monthly_fee", "300", "Get $ 300 with a direct deposit"),
    ("money_that_is_no_fee", "chequing", "A", "monthly_fee", "1,200", "a fee of $5; a purchase of $1,200 counts"),
    (None, "chequing", "A", "monthly_fee", "5", "Monthly fee $5. " + "Words in between. " * 9 + "Get $300 as a cash bonus"),
    ("copy_of_a_calculator", "savings", "A", "minimum_balance", "500", "This calculator is for illustrative purposes only. $500"),
    ("fee_by_plan", "savings", "A", "monthly_fee", "0", "Fees depend on the bank plan"),
    (None, "savings", "A", "monthly_fee", "4", "Fees depend on the bank plan. $4"),
    ("fee_of_a_second_card", "credit-card", "A", "annual_fee", "0", "Annual fee for authorized card: $0"),
    (None, "credit-card", "A", "annual_fee", "0", "Annual fee for primary cardholder: $0, additional: $0"),
    ("card_rate_without_its_label", "credit-card", "A", "purchase_interest_rate", "19.99", "Cash advances 19.99%"),
    ("card_rate_without_its_label", "credit-card", "A", "balance_transfer_rate", "1.99", "Purchases 1.99%"),
    ("card_rate_without_its_label", "credit-card", "A", "cash_advance_rate", "22.99", "Purchases 22.99%"),
    (None, "credit-card", "A", "cash_advance_rate", "22.99", "Cash advance rate 22.99%"),
    ("rewards_of_a_low_rate_card", "credit-card", "A", "rewards_summary", "Save", "Our lowest rate card"),
    (None, "credit-card", "A", "rewards_summary", "Points", "Our lowest rate card with points"),
    ("security_without_evidence", "personal-loan", "A", "collateral_text", "Your car", "Cars"),
    (None, "personal-loan", "A", "collateral_text", "Your car", "Secured by your car"),
    ("end_of_an_offer_as_effective_date", "gic", "A", "effective_date", "2026-05-01", "Offer ends May 1, 2026"),
    ("field_of_another_family", "gic", "A", "withdrawal_limit_text", "Two", "Two"),
    (None, "savings", "A", "withdrawal_limit_text", "Two", "Two"),
    ("no_boolean", "gic", "A", "redeemable_flag", "maybe", "Redeemable"),
    (None, "gic", "A", "redeemable_flag", "Yes", "Redeemable"),
    ("navigation_copy", "savings", "A", "eligibility_text", "Learn More", "x"),
    ("navigation_copy", "savings", "A", "eligibility_text", "Document rates here", "x"),
    ("navigation_copy", "savings", "A", "eligibility_text", "Main navigation Careers Accessibility " + "and some more words " * 8, "x"),
    (None, "savings", "A", "eligibility_text", "Main navigation Careers " + "and some more words " * 8, "x"),
    ("offer_or_quiz_as_description", "savings", "A", "description_short", "Our extras:", "x"),
    ("offer_or_quiz_as_description", "savings", "A", "description_short", "Book now, or call us", "x"),
    ("description_of_another_type", "chequing", "A", "description_short", "A savings account", "x"),
    ("description_of_another_type", "savings", "A", "description_short", "A chequing account", "x"),
    (None, "savings", "A", "description_short", "A chequing account with savings", "x"),
    ("no_rate", "mortgage", "A", "mortgage_rate", "Ask one of our advisors about all the terms there are", "x"),
    (None, "mortgage", "A", "mortgage_rate", "Prime rate less half of what the branch has agreed to", "x"),
    ("instructions_as_eligibility", "savings", "A", "eligibility_text", "To apply, you'll need a passport", "x"),
    ("no_tax_benefit", "gic", "A", "tax_benefits", "Peace of mind", "x"),
    ("tax_of_another_plan", "gic", "RRSP GIC", "tax_benefits", "Tax-free growth", "x"),
    ("tax_of_another_plan", "gic", "TFSA GIC", "tax_benefits", "Tax sheltered until retirement", "x"),
    (None, "gic", "TFSA GIC", "tax_benefits", "Tax-free growth", "x"),
    ("one_of_several_frequencies", "gic", "A", "payout_option", "monthly", "Paid monthly or at maturity"),
    ("frequency_of_payments", "mortgage", "A", "compounding_frequency", "weekly", "Payment frequency: weekly"),
    ("no_payment_frequency", "mortgage", "A", "payment_frequency", "Use our calculator", "x"),
    (None, "mortgage", "A", "payment_frequency", "Accelerated weekly", "x"),
    ("no_amortization", "mortgage", "A", "amortization_text", "Long", "x"),
    (None, "mortgage", "A", "amortization_text", "25 years", "x"),
    ("no_way_to_apply", "savings", "A", "application_method", "Sign in to online banking", "x"),
    ("no_way_to_apply", "savings", "A", "application_method", "Cheques and ABM", "Ways to access"),
    ("way_to_another_product", "mortgage", "A", "application_method", "Open a bank account", "x"),
    (None, "mortgage", "A", "application_method", "Apply for a mortgage from your bank account", "x"),
    ("no_fees", "mortgage", "A", "fees_text", "Repay without penalty", "x"),
    (None, "savings", "A", "fees_text", "Repay without penalty", "x"),
    ("no_payment", "personal-loan", "A", "monthly_payment_text", "As you like", "x"),
    ("no_payment", "personal-loan", "A", "minimum_payment_text", "As you like", "x"),
    (None, "personal-loan", "A", "minimum_payment_text", "Interest only", "x"),
    ("no_amount", "personal-loan", "A", "loan_amount_text", "as much as you may ever need " * 4, "x"),
    ("title_alone", "personal-loan", "A", "collateral_text", "Is collateral required", "secured"),
    ("no_privilege", "mortgage", "A", "prepayment_privileges", "None", "x"),
    ("no_method", "savings", "A", "interest_calculation_method", "Daily", "x"),
    ("legal_notes", "savings", "A", "notes", "Legal footnote 3", "x"),
    ("page_of_an_insurer", "savings", "A", "deposit_insurance", "Contact us, careers and community", "x"),
    ("page_copy", "savings", "A", "term_length_text", "a term of some years " * 13, "x"),
    (None, "savings", "A", "notes", None, None),
    (None, None, None, "notes", "kept", None),
]


def test_each_rule_on_texts(spark):
    df = spark.createDataFrame([(f"K{k}", *c[1:]) for k, c in enumerate(CASES)], SCHEMA)
    got = {r.candidate_id: r.reason for r in cleaning.reasons(df, "candidate_id", F.lit(DAY).cast("date")).collect()}
    assert got == {f"K{k}": c[0] for k, c in enumerate(CASES)}
    assert {r.reason for r in fieldrules.SUPPRESSIONS} <= {c[0] for c in CASES}


def test_rules_on_several_fields_of_a_candidate(spark):
    long = "a text that a reader took for the value of several fields, though it is one part of the page alone"
    table = '[{"term_label": "1 year", "rate": "4%"}, {"term_label": "2 years", "rate": "5%"}]'
    rows = [
        ("a", "savings", "n", "description_short", long, "x"), ("a", "savings", "n", "eligibility_text", long.upper() + " .", "x"), ("b", "savings", "n", "eligibility_text", long, "x"), ("b", "savings", "n", "notes", long, "x"),
        ("c", "gic", "n", "term_length_days", "90", "x"), ("c", "gic", "n", "term_length_text", "1 year", "x"), ("d", "gic", "n", "term_length_days", "360", "x"), ("d", "gic", "n", "term_length_text", "1 year", "x"),
        ("e", "gic", "n", "term_length_days", "365", "x"), ("e", "gic", "n", "term_length_text", "1 year", "x"), ("e", "gic", "n", "term_rate_table", table, "x"),
        ("f", "gic", "n", "term_length_text", "1 to 2 years, or 90 days", "x"), ("f", "gic", "n", "term_rate_table", table, "x"), ("g", "gic", "n", "notes", "short", "x"), ("g", "gic", "n", "payment_frequency", "short", "x"),
    ]
    got = {(r.candidate_id, r.field): r.reason for r in cleaning.reasons(spark.createDataFrame(rows, SCHEMA), "candidate_id", F.lit(DAY).cast("date")).collect()}
    assert got == {
        ("a", "description_short"): None, ("a", "eligibility_text"): "copy_in_several_fields", ("b", "eligibility_text"): "copy_in_several_fields", ("b", "notes"): "copy_in_several_fields",
        ("c", "term_length_days"): "days_against_words", ("c", "term_length_text"): None, ("d", "term_length_days"): None, ("d", "term_length_text"): None,
        ("e", "term_length_days"): "one_term_of_several", ("e", "term_length_text"): "one_term_of_several", ("e", "term_rate_table"): None,
        ("f", "term_length_text"): None, ("f", "term_rate_table"): None, ("g", "notes"): None, ("g", "payment_frequency"): "no_payment_frequency",
    }


def test_values_in_their_types(spark):
    rows = [
        ("standard_rate", "4.49%", "decimal", 4.49), ("monthly_fee", "$1,200.50", "decimal", 1200.5), ("monthly_fee", "No monthly fee", "decimal", 0.0), ("standard_rate", "free", "decimal", None), ("teller_fee", "7", "decimal", 7.0),
        ("term_length_days", "365", "integer", 365), ("term_length_days", "365.5", "integer", None), ("redeemable_flag", "TRUE", "boolean", True), ("redeemable_flag", "yes", "boolean", False), ("notes", " a b ", "string", "a b"), ("unheard_of", "x", "string", "x"),
        ("notes", "  ", "string", None), ("standard_rate", None, "decimal", None), ("term_rate_table", '[{"term_label": "18 months", "rate": "4.5%"}, {"term_length_days": 90, "rate": 3}, {"term_label": "x"}]', "json", [(540, 4.5), (90, 3.0)]),
        ("term_rate_table", "1 year 4.5% 2 years 4.75%", "json", [(365, 4.5), (730, 4.75)]), ("term_rate_table", "no table", "json", None),
    ]
    df = spark.createDataFrame([(k, f, v) for k, (f, v, _, _) in enumerate(rows)], "k int, field string, value string").select("k", contracts.normalized(F.col("field"), F.col("value")).alias("n"))
    for r in df.collect():
        _, _, kind, want = rows[r.k]
        values = [x for x in (r.n.text, r.n.number, r.n.whole, r.n.flag, r.n.rows and [tuple(p) for p in r.n.rows]) if x is not None]
        assert r.n.type == kind and values == ([want] if want is not None else []), rows[r.k]


def test_lines_are_tested_once_for_all_fields(spark):
    plan = plans.line_noise(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode\(\[interest_rate.*Aggregate \[.*Generate explode\(split\(text", plan, re.S)


def test_breaches_of_contracts(spark):
    rows = [
        (1, '{"monthly_fee": "12", "term_length_days": 365.5, "redeemable_flag": "yes", "unheard_of": {"a": 1}, "annual_fee": 3, "interest_rate": 4.25, "term_rate_table": "x", "notes": [1], "product_name": null}'),
        (2, '{"monthly_fee": 12, "term_length_days": 365, "redeemable_flag": true, "term_rate_table": [1], "product_name": "n", "new_rate": false}'),
        (3, "no json"), (4, "[1]"), (5, None), (6, "{}"), (7, '{"monthly_fee": "12"} and more'),
    ]
    got = {(r.id, r.field, r.value_type, r.found) for r in cleaning.breaches(spark.createDataFrame(rows, "id long, payload string"), "id", "payload").collect()}
    assert got == {(1, "monthly_fee", "decimal", "string"), (1, "term_length_days", "integer", "decimal"), (1, "redeemable_flag", "boolean", "string"), (1, "term_rate_table", "json", "string"), (1, "notes", "string", "json"), (2, "new_rate", "decimal", "boolean")}


def test_mended_descriptions(spark):
    texts = {"Alittle account. Try our Gold Card now. More!": "A little account. More!", "If you like it, explore our car loan. Fine": "Fine", "Try our ideas.": "Try our ideas.", "": "", None: None}
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r.x: r.y for r in df.select("x", cleaning.mended(F.col("x")).alias("y")).collect()} == texts


@pytest.mark.parametrize(
    "field, text, zero, want",
    [
        ("monthly_fee", "the standard monthly fee is $5", False, 8), ("monthly_fee", "as low as $0 with a rebate", True, -15), ("monthly_fee", "no monthly fee if you maintain $4,000", True, -14), ("public_display_fee", "monthly fee: $5", False, 8),
        ("unlimited_transactions_flag", "unlimited debit transactions", False, 8), ("promotional_rate", "earn up to 5% for the first 3 months", False, 10), ("promotional_rate", "an extra 2%", False, -5),
        ("public_display_rate", "earn up to 5%", False, 12), ("public_display_rate", "interest rate with bonus, an additional 1%", False, 5), ("eligibility_text", "maintain an eligible account and complete at least 2 of 3 qualifying payments", False, 16),
        ("eligibility_text", "you could earn more when you start with an eligible account", False, -4), ("notes", "eligibility", False, 0),
    ],
)
def test_points_of_evidence(spark, field, text, zero, want):
    assert spark.createDataFrame([(field, text, zero)], "field string, x string, zero boolean").select(fieldrules.points().alias("p")).first().p == want


def test_signals_of_chunks(spark):
    rows = [
        ("standard_rate", "4%", 0.62), ("standard_rate", "interest", 0.18), ("minimum_balance", "no minimum balance", 0.5), ("transfer_fee", "$1", 0.18), ("e_transfer_flag", "free interac e-transfer", 0.5), ("e_transfer_flag", "interac", 0.18),
        ("student_plan_flag", "for youth", 0.18), ("newcomer_plan_flag", "new to canada", 0.18), ("term_rate_table", "4% a year", 0.62), ("term_table", "x", 0.05), ("notes", "anything", 0.05),
    ]
    df = spark.createDataFrame(rows, "field string, x string, want double")
    assert [r for r in df.select("field", "x", "want", fieldrules.signal().cast("double").alias("got")).collect() if r.got != r.want] == []
