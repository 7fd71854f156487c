"""Gates of publication and diagnoses for reviewers, each on a candidate that meets it."""

import json

from quarrystone.operators import review

SCHEMA = "n int, codes array<string>, validation_status string, applicable boolean, contract_defined boolean, complete boolean, missing array<string>, dynamic boolean, grounded boolean, source_role string, reasons array<string>, product_name string, payload string"
SOUND = {"codes": [], "validation_status": "pass", "applicable": True, "contract_defined": True, "complete": True, "missing": [], "dynamic": False, "grounded": None, "source_role": "detail", "reasons": None, "product_name": "Harbour Savings", "payload": "{}"}


def table(spark, changes):
    return spark.createDataFrame([(n, *(SOUND | c).values()) for n, c in enumerate(changes)], SCHEMA)


def test_gates(spark):
    cases = [
        ({}, None, "promoted"), ({"codes": ["conflicting_evidence"]}, "force_review_issue_code", "queued_for_review"), ({"codes": ["partial_source_failure"]}, None, "promoted"), ({"codes": ["invalid_term_value"]}, None, "promoted"),
        ({"complete": False}, "comparison_fields_missing", "queued_for_review"), ({"complete": False, "applicable": False}, None, "promoted"), ({"contract_defined": False}, "comparison_fields_missing", "queued_for_review"),
        ({"dynamic": True}, "ai_grounding_insufficient", "queued_for_review"), ({"dynamic": True, "grounded": True}, None, "promoted"), ({"source_role": " "}, "source_role_missing", "queued_for_review"), ({"source_role": None}, "source_role_missing", "queued_for_review"),
        ({"source_role": "supporting_html"}, "non_detail_source_role", "rejected"), ({"reasons": ["x", "Article"]}, "non_product_source", "rejected"), ({"reasons": ["multi_product_family_overview"]}, "ambiguous_product_boundary", "queued_for_review"),
        ({"product_name": "Mortgage calculator"}, "non_product_name", "rejected"), ({"product_name": "Account  Fees"}, "non_product_name", "rejected"), ({"product_name": "See our best rates"}, "non_product_name", "rejected"), ({"product_name": "Banking for newcomers"}, "non_product_name", "rejected"),
        ({"product_name": "Benefits of saving"}, "non_product_name", "rejected"), ({"product_name": "Checking rates"}, None, "promoted"), ({"product_name": None}, None, "promoted"), ({"codes": ["conflicting_evidence"], "source_role": None}, "force_review_issue_code", "queued_for_review"),
    ]
    found = review.promoted(table(spark, [c[0] for c in cases]), ["conflicting_evidence", "partial_source_failure"])
    got = {r.n: (r.skip_reason, r.action) for r in found.collect()}
    assert [got[n] for n in range(len(cases))] == [c[1:] for c in cases]


def test_diagnoses(spark):
    long = "this text was taken from the page for the value of more than one field of the product at hand"
    text = json.dumps
    cases = [
        ({}, "evidence_review", "approve", []), ({"source_role": "supporting_pdf", "missing": ["monthly_fee"]}, "non_product_source", "reject", []), ({"source_role": None}, "evidence_review", "approve", []), ({"reasons": ["help_page"]}, "non_product_source", "reject", []),
        ({"codes": ["ambiguous_product_boundary"]}, "ambiguous_product_boundary", "defer", []), ({"missing": ["monthly_fee", "standard_rate"]}, "missing_fields", "edit_approve", [("monthly_fee", "Monthly Fee", "missing"), ("standard_rate", "Standard Rate", "missing")]),
        ({"validation_status": "error"}, "validation_error", "edit_approve", []), ({"validation_status": "error", "codes": ["conflicting_evidence"]}, "validation_error", "defer", []),
        ({"payload": text({"payment_frequency": "Use our calculator", "notes": "x"}), "missing": ["monthly_fee"]}, "suspect_fields", "edit_approve", [("monthly_fee", "Monthly Fee", "missing"), ("payment_frequency", "Payment Frequency", "non_value_copy")]),
        ({"payload": text({"payment_frequency": ""}), "missing": ["payment_frequency"]}, "suspect_fields", "edit_approve", [("payment_frequency", "Payment Frequency", "missing")]),
        ({"payload": text({"term_length_days": 90, "term_length_text": "1 year"})}, "suspect_fields", "edit_approve", [("term_length_days", "Term Length Days", "cross_field_conflict")]),
        ({"payload": text({"term_length_days": 365, "term_length_text": "1 year"})}, "evidence_review", "approve", []),
        ({"payload": text({"eligibility_text": long, "description_short": long, "notes": long + "."})}, "suspect_fields", "edit_approve", [("eligibility_text", "Eligibility Text", "duplicated_page_copy"), ("notes", "Notes", "duplicated_page_copy")]),
        ({"payload": text({"product_name": "See our rates", "notes": "{{open}}"})}, "suspect_fields", "edit_approve", [("notes", "Notes", "unresolved_placeholder"), ("product_name", "Product Name", "cta_copy")]),
        ({"payload": "no json"}, "evidence_review", "approve", []), ({"payload": None, "missing": None}, "evidence_review", "approve", []),
    ]
    found = {r.n: r for r in review.diagnosed(table(spark, [c[0] for c in cases]), "n", "payload").collect()}
    assert [(found[n].category, found[n].recommended_action, [tuple(a) for a in found[n].affected]) for n in range(len(cases))] == [c[1:] for c in cases]
    assert found[5].headline == "2 required fields are missing." and found[8].headline == "2 fields need attention." and found[10].headline == "1 field needs attention."
