"""Parsers of fields on sentences of pages, and the order in which they count."""

from quarrystone.operators import extraction

SCHEMA = "candidate_id string, family string, chunk_id string, chunk_index int, text string"


def read(spark, family, *chunks, **how):
    df = spark.createDataFrame([("k", family, f"c{n}", n, t) for n, t in enumerate(chunks)], SCHEMA)
    return {r.field: r.value for r in extraction.extract(df, "candidate_id", **how).collect()}


SENTENCES = [
    ("chequing", "Monthly fee: $10.95", {"monthly_fee": "10.95"}),
    ("chequing", "$1,004.50 monthly fee", {"monthly_fee": "1004.50"}),
    ("chequing", "Monthly fee waived with a $4,000 minimum balance", {"fee_waiver_condition": "Monthly fee waived with a $4,000 minimum balance", "minimum_balance": "4000"}),
    ("chequing", "No monthly fee when you maintain $3,000", {"fee_waiver_condition": "No monthly fee when you maintain $3,000"}),
    ("chequing", "No monthly fee. No minimum balance", {"monthly_fee": "0", "minimum_balance": "0"}),
    ("chequing", "12 free debit transactions; additional transactions $1.25 per transaction", {"included_transactions": "12", "transaction_fee": "1.25"}),
    ("chequing", "Unlimited everyday transactions and free e-Transfer", {"unlimited_transactions_flag": "true", "interac_e_transfer_included": "true"}),
    ("chequing", "e-Transfer: a fee of $1 each", {}),
    ("savings", "Earn up to 5.25% for the first 3 months", {"promotional_rate": "5.25", "promotional_period_text": "for the first 3 months"}),
    ("savings", "An extra promotional rate of 1%", {}),
    ("savings", "The regular interest rate is 1.75%", {"standard_rate": "1.75"}),
    ("savings", "Interest is calculated daily and paid monthly", {"interest_calculation_method": "Interest is calculated daily and paid monthly", "interest_payment_frequency": "monthly"}),
    ("gic", "Non-redeemable, 1 year term", {"redeemable_flag": "false", "non_redeemable_flag": "true", "term_length_text": "1 year"}),
    ("gic", "Cashable GIC in your RRSP", {"redeemable_flag": "true", "registered_plan_supported": "true"}),
    ("gic", "Invest from $500", {"minimum_deposit": "500"}),
    ("mortgage", "Invest from $500", {}),
    ("gic", "Interest compounded semi-annually", {"compounding_frequency": "semi-annually"}),
    ("gic", "Interest paid monthly or at maturity", {}),
    ("credit-card", "Annual fee: $120", {"annual_fee": "120"}),
    ("credit-card", "Annual fee for additional card: $30", {}),
    ("credit-card", "Purchase rate: 19.99%. Cash advance rate: 22.99%. Balance transfer rate: 20%", {"purchase_interest_rate": "19.99", "cash_advance_rate": "22.99", "balance_transfer_rate": "20"}),
    ("credit-card", "Introductory purchase rate of 0%", {}),
    ("credit-card", "Purchase APR: 19.49% to 29.49% variable", {"purchase_interest_rate": "19.49", "purchase_interest_rate_summary": "Purchase APR: 19.49% to 29.49% variable"}),
    ("mortgage", "5-year fixed rate: 4.89%", {"mortgage_rate": "4.89", "rate_type": "fixed"}),
    ("mortgage", "A variable rate of prime less 0.5%", {"rate_type": "variable"}),
    ("mortgage", "Amortization of up to 30 years", {"amortization_text": "30 years"}),
    ("personal-loan", "Borrow $5,000 to $50,000, unsecured", {"loan_amount_text": "Borrow $5,000 to $50,000, unsecured", "secured_flag": "false"}),
    ("line-of-credit", "Secured by your home", {"secured_flag": "true"}),
    ("savings", "Apply online or by phone | CDIC insured", {"application_method": "Apply online or by phone", "deposit_insurance": "CDIC insured"}),
    ("savings", "Nothing of use", {}),
    ("savings", None, {}),
    (None, "Monthly fee: $5. Annual fee: $9", {"monthly_fee": "5"}),
]


def test_sentences(spark):
    df = spark.createDataFrame([(str(k), family, f"c{k}", 0, text) for k, (family, text, _) in enumerate(SENTENCES)], SCHEMA)
    got = {}
    for r in extraction.extract(df, "candidate_id").collect():
        got.setdefault(int(r.candidate_id), {})[r.field] = r.value
    assert [got.get(k, {}) for k in range(len(SENTENCES))] == [want for _, _, want in SENTENCES]


def test_the_label_of_a_field_comes_before_what_hints_at_it(spark):
    assert read(spark, "chequing", "$4 per month", "Monthly fee: $10.95")["monthly_fee"] == "10.95"
    assert read(spark, "chequing", "No monthly fee for savings. Monthly fee: $10.95")["monthly_fee"] == "10.95"
    assert read(spark, "gic", "Start with $25", "Minimum deposit: $500", "Minimum investment: $900")["minimum_deposit"] == "500"
    df = spark.createDataFrame([("k", "chequing", "c0", 0, "Monthly fee: $1"), ("k", "chequing", "c1", 1, "Monthly fee: $2")], SCHEMA)
    refused = df.where("chunk_id = 'c0'")
    rows = extraction.extract(df, "candidate_id", refused).collect()
    assert [(r.value, r.chunk_id, r.quote) for r in rows] == [("2", "c1", "Monthly fee: $2")]
    assert read(spark, "chequing", "Monthly fee: $1. No minimum balance", requested=["minimum_balance"]) == {"minimum_balance": "0"} and extraction.extract(df.limit(0), "candidate_id").count() == 0
