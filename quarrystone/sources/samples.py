"""Texts of product pages, as the pages of banks have them, for relations that need prose which the base tables don't hold."""

from __future__ import annotations

_PAGE = "Main navigation Online banking Find a branch About us Contact us Careers Accessibility Credit cards Mortgages and more of what every page of this site shows at its top and again at its foot"
_LONG = "This text stands in several fields of one candidate because a reader took the whole page for the value of each of them."

#: Candidates as (family, product name, fields), each field as (name, value, evidence).
CANDIDATES = (
    ("savings", "Harbour Savings", (("monthly_fee", "5", "Monthly fee: $5"), ("standard_rate", "2.5", "The interest rate is 2.5%"), ("description_short", "Alittle account for saving. Explore our Gold Card today!", "Save with us"))),
    ("savings", "Harbour Saver", (("standard_rate", "4.5", "Promotional rate of 4.5% for the first 3 months"), ("description_short", "Special offer", "Offer"), ("interest_calculation_method", "Choose any bank", "Choose up to 4 banks to compare. National average is based on 9 banks"))),
    ("savings", "Tide Savings", (("standard_rate", "3", "Rates from 2.75%"), ("monthly_fee", "300", "Get a $300 cash bonus with a direct deposit"), ("description_short", "The chequing account for every day", "Bank"))),
    ("savings", "Reef Savings", (("public_display_rate", "12.5", "Earn 12.5% interest"), ("highest_rate", "0", "This account pays no interest"), ("payment_frequency", "See our calculator", "Payments"))),
    ("chequing", "Everyday Chequing", (("description_short", "A savings account that grows", "Grow"), ("application_method", "Sign in to online banking to begin", "Apply"), ("student_plan_flag", "true", "Excludes student, youth and senior plans"))),
    ("chequing", "Plain Chequing", (("monthly_fee", "0", "No monthly fee for savings; for this account the fee depends on the plan"), ("application_method", "Mobile app and cheques", "Ways to access your account"), ("unlimited_transactions_flag", "maybe", "Transactions"))),
    ("gic", "Cashable GIC", (("included_transactions", "12", "12 transactions"), ("term_length_days", "90", "Terms"), ("term_length_text", "1 year to 5 years", "Terms"), ("standard_rate", "3.1", "a full term return of 3.1% after 5 years"))),
    ("gic", "RRSP GIC", (("tax_benefits", "Grow tax-free in a TFSA", "Plans"), ("application_method", "Open a savings account online", "Apply"), ("standard_rate", "rds%rate", "{{{{rate}}}}"))),
    ("gic", "TFSA GIC", (("tax_benefits", "Tax-deferred until retirement", "Plans"), ("term_rate_table", '[{{"term_label": "1 year", "rate": "4.5%"}}, {{"term_label": "2 years", "rate": "4.75%"}}]', "1 year 4.5% 2 years 4.75%"), ("term_length_text", "1 year", "Term"), ("term_length_days", "365", "Term"))),
    ("gic", "Fixed GIC", (("tax_benefits", "Safe and sound", "Plans"), ("compounding_frequency", "monthly", "Interest is paid monthly or at maturity"), ("effective_date", "2026-05-01", "Offer ends May 1, 2026"), ("base_12_month_rate", "4", "Offer valid until March 1, 2026. Rate of 4%"))),
    ("credit-card", "Gold Card", (("annual_fee", "0", "Annual fee for additional card: $0"), ("purchase_interest_rate", "19.99", "Cash advances 19.99%"), ("cash_advance_rate", "22.99", "Cash advance rate: 22.99%"), ("rewards_summary", "None", "Our lowest rate card"))),
    ("credit-card", "Silver Card", (("annual_fee", "0", "No annual fee. Annual fee for additional cards: $0"), ("purchase_interest_rate", "19.99", "Purchase APR 19.99%"), ("balance_transfer_rate", "1.99", "Purchases 1.99%"), ("rewards_summary", "2 points", "lowest rate card with points"))),
    ("mortgage", "Fixed Mortgage", (("mortgage_rate", "xx.xx%", "Rate"), ("amortization_text", "Up to 30 years", "Amortization"), ("prepayment_privileges", "None named", "Privileges"), ("payment_frequency", "Weekly or monthly", "Payment frequency"), ("interest_payment_frequency", "weekly", "Payment frequency: weekly"))),
    ("mortgage", "Variable Mortgage", (("mortgage_rate", "5.1", "Interest rate 5.1% in related products"), ("amortization_text", "As you like", "Amortization"), ("prepayment_privileges", "Prepay 15% a year", "Privileges"), ("application_method", "Open a bank account", "Apply"))),
    ("personal-loan", "Car Loan", (("monthly_payment_text", "See how much you can borrow", "Calculator"), ("minimum_payment_text", "Interest only", "Payments"), ("fees_text", "Repay without penalty", "Fees"), ("collateral_text", "Your car", "Cars"), ("interest_rate", "14.5", "Interest rate 14.5%"))),
    ("personal-loan", "Home Loan", (("monthly_payment_text", "Payments of $300", "Payments"), ("fees_text", "No setup fee", "Fees"), ("security_requirement", "Security requirements", "secured by your home"), ("loan_amount_text", "As much as your plans, your home and your dreams may ask for in this and in all the years that are to come", "Amounts"))),
    ("line-of-credit", "Home Line", (("interest_rate", "Ask one of our friendly advisors about the best of terms", "Rates"), ("eligibility_text", "To apply, you'll need two documents", "Apply"), ("notes", "Legal footnote 3", "Notes"), ("deposit_insurance", "Contact us, rates and careers", "CDIC"))),
    ("line-of-credit", "Student Line", (("credit_limit_text", _LONG, "Limits"), ("loan_amount_text", _LONG + " up to", "Limits"), ("fees_text", f"{_LONG} .", "Limits"), ("description_short", _LONG, "Limits"), ("eligibility_text", _PAGE, "Pages"))),
    ("savings", "Quiz Savings", (("description_short", "Still not sure? Answer a few quick questions", "Help"), ("application_method", "How do I apply for this", "Apply"), ("withdrawal_limit_text", "skip to main content", "Limits"), ("rate_type", None, None))),
    ("chequing", None, (("description_short", "Banking with these extras:", None), ("monthly_fee", "$1,200.50", "Monthly fee $1,200.50"), ("included_transactions", "25", "25 transactions"), ("overdraft_available", "TRUE", "Overdraft"), ("product_name", "Plain", "Plain"))),
)

#: Pages as (family, chunks), each chunk as a page has it.
PAGES = (
    ("chequing", ("Everyday banking. Monthly fee: $10.95. Monthly fee waived with a $4,000 minimum balance", "25 transactions included; each additional transaction costs $1.25. Free Interac e-Transfer transfers", "Overdraft protection is there; for students it is free for 4 years. Open online or visit a branch.")),
    ("chequing", ("No monthly fee. Unlimited debit transactions. No minimum balance", "You must be the age of majority. CDIC insured deposits")),
    ("savings", ("Earn 5.25% for the first 3 months. The standard rate is 1.5%", "Interest is calculated daily and paid monthly. No monthly fee. Start with $25", "Promotional rate of 4.75% for 120 days, TFSA or RRSP")),
    ("savings", ("Interest rate: 2.1%. An additional 1% is yours. No minimum deposit", "$4 per month. Newcomers to Canada: new to Canada bonus")),
    ("gic", ("Non-redeemable. 1 year term at an annual rate of 4.5%. Minimum investment $1,000", "Interest is compounded annually; paid at maturity. Tax-free in a TFSA", "Minimum deposit: $500")),
    ("gic", ("Cashable at any time. 90 days term. Invest from $100. Interest paid monthly or at maturity", "Regular rate 3.05%")),
    ("credit-card", ("Annual fee: $120; annual fee for additional card $30", "Purchase rate 19.99%. Cash advance rate: 22.99%. Balance transfer: 20.5%", "Purchase APR of 19.49% to 29.49% variable. Minimum payment is $10. Credit limit of $5,000")),
    ("credit-card", ("No annual fee. Introductory purchase rate 0% for the first 9 months", "20.99% on purchases")),
    ("mortgage", ("5-year fixed rate of 4.89%. Amortization up to 30 years. Prepay up to 15% each year", "Prime rate less 0.5%. Weekly, biweekly or monthly payments")),
    ("personal-loan", ("Borrow $5,000 to $50,000. Interest rate of 8.99%. Unsecured", "Apply online. Fixed interest for 3 year term. Make biweekly payments")),
    ("line-of-credit", ("Secured by your home. Prime plus 0.5%. Borrow up to 65% of its value", "Interest only. To qualify, own a home|Book an appointment")),
    ("savings", ("Nothing of use here", "", "Rates")),
)


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def candidate_fields(key: str, table: str) -> str:
    """SQL of (candidate_id, family, product_name, field, value, context): each row of ``table`` has the fields of one candidate in turn."""
    rows = [(n, family, name, *field) for n, (family, name, fields) in enumerate(CANDIDATES) for field in fields]
    # the apostrophes of English texts are written as typographic ones in Spark and DuckDB alike
    values = ", ".join(f"({n}, {', '.join(_literal(x.replace(chr(39), chr(0x2019)) if x else x) for x in rest)})" for n, *rest in rows)
    return f"SELECT concat('K', CAST({key} AS STRING)) AS candidate_id, family, product_name, field, value, context FROM {table} JOIN (VALUES {values}) AS listed (n, family, product_name, field, value, context) ON {key} % {len(CANDIDATES)} = n"


def page_chunks(key: str, table: str) -> str:
    """SQL of (candidate_id, family, chunk_id, chunk_index, text): each row of ``table`` has the chunks of one page in turn."""
    rows = [(n, family, k, text) for n, (family, chunks) in enumerate(PAGES) for k, text in enumerate(chunks)]
    values = ", ".join(f"({n}, {_literal(family)}, {k}, {_literal(text)})" for n, family, k, text in rows)
    return f"SELECT concat('K', CAST({key} AS STRING)) AS candidate_id, family, concat('K', CAST({key} AS STRING), '-', CAST(chunk_index AS STRING)) AS chunk_id, chunk_index, text FROM {table} JOIN (VALUES {values}) AS listed (n, family, chunk_index, text) ON {key} % {len(PAGES)} = n"
