"""Rules on the values of product fields: tables of tests that become one expression, in Spark and in SQL.

A rule is a reason, the fields and families that it is asked for, and a test. Tests are put
together from words that a text holds, lengths and flags; ``spark`` and ``sql`` render each
on its own. The first rule that holds gives the reason; a null text holds nothing.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import text as tx


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


class Test:
    """Something that a row passes or not, never null."""

    def spark(self) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def __and__(self, other: Test) -> Test:
        return Both(self, other)

    def __or__(self, other: Test) -> Test:
        return Either(self, other)

    def __invert__(self) -> Test:
        return No(self)


class Both(Test):
    def __init__(self, a: Test, b: Test):
        self.a, self.b = a, b

    def spark(self):
        return self.a.spark() & self.b.spark()

    def sql(self):
        return f"({self.a.sql()} AND {self.b.sql()})"


class Either(Both):
    def spark(self):
        return self.a.spark() | self.b.spark()

    def sql(self):
        return f"({self.a.sql()} OR {self.b.sql()})"


class No(Test):
    def __init__(self, a: Test):
        self.a = a

    def spark(self):
        return ~self.a.spark()

    def sql(self):
        return f"NOT {self.a.sql()}"


class Holds(Test):
    """``least`` of the phrases stand in a column's text."""

    def __init__(self, column: str, *phrases: str, least: int = 1):
        self.column, self.phrases, self.least = column, phrases, least

    def each(self, p: str) -> Column:
        return F.col(self.column).contains(p)

    def each_sql(self, p: str) -> str:
        return f"contains({self.column}, {quoted(p)})"

    def spark(self):
        found = [F.coalesce(self.each(p), F.lit(False)) for p in self.phrases]
        return reduce(lambda a, b: a | b, found) if self.least == 1 else reduce(lambda a, b: a + b, [f.cast("int") for f in found]) >= self.least

    def sql(self):
        found = [f"coalesce({self.each_sql(p)}, false)" for p in self.phrases]
        return f"({' OR '.join(found)})" if self.least == 1 else f"({' + '.join(f'CAST({f} AS INTEGER)' for f in found)} >= {self.least})"


class Starts(Holds):
    def each(self, p):
        return F.col(self.column).startswith(p)

    def each_sql(self, p):
        return f"starts_with({self.column}, {quoted(p)})"


class Ends(Holds):
    def each(self, p):
        return F.col(self.column).endswith(p)

    def each_sql(self, p):
        return f"suffix({self.column}, {quoted(p)})"


class Is(Holds):
    def each(self, p):
        return F.col(self.column) == p

    def each_sql(self, p):
        return f"{self.column} = {quoted(p)}"


class Matches(Test):
    """A pattern that both engines read alike."""

    def __init__(self, column: str, pattern: str):
        self.column, self.pattern = column, pattern

    def spark(self):
        return F.coalesce(F.col(self.column).rlike(self.pattern), F.lit(False))

    def sql(self):
        return f"coalesce(regexp_matches({self.column}, {quoted(self.pattern)}), false)"


class Length(Test):
    """At least ``least`` characters, and less than ``below`` if that is given."""

    def __init__(self, column: str, least: int = 0, below: int | None = None):
        self.column, self.least, self.below = column, least, below

    def spark(self):
        n = F.coalesce(F.length(self.column), F.lit(0))
        return (n >= self.least) & (n < self.below) if self.below else n >= self.least

    def sql(self):
        n = f"coalesce(length({self.column}), 0)"
        return f"({n} >= {self.least} AND {n} < {self.below})" if self.below else f"({n} >= {self.least})"


class Words(Length):
    def spark(self):
        return F.size(F.split(F.coalesce(self.column, F.lit("")), " ")) < self.below

    def sql(self):
        return f"(len(string_split(coalesce({self.column}, ''), ' ')) < {self.below})"


class Flag(Test):
    """A condition that both engines read alike; null counts as no."""

    def __init__(self, condition: str):
        self.condition = condition

    def spark(self):
        return F.coalesce(F.expr(self.condition), F.lit(False))

    def sql(self):
        return f"coalesce({self.condition}, false)"


class Rule(NamedTuple):
    reason: str
    test: Test
    fields: tuple[str, ...] = ()
    families: tuple[str, ...] = ()

    def whole(self) -> Test:
        """The test with what it is asked for; a field that begins with * is an ending."""
        out = self.test
        if self.families:
            out = Is("family", *self.families) & out
        if self.fields:
            names, endings = [f for f in self.fields if f[0] != "*"], [f[1:] for f in self.fields if f[0] == "*"]
            asked = [t for t in (Is("field", *names) if names else None, Ends("field", *endings) if endings else None) if t]
            out = reduce(lambda a, b: a | b, asked) & out
        return out


def first_reason(rules: tuple[Rule, ...]) -> Column:
    out = None
    for rule in rules:
        test = rule.whole().spark()
        out = F.when(test, rule.reason) if out is None else out.when(test, rule.reason)
    return out


def first_reason_sql(rules: tuple[Rule, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {r.whole().sql()} THEN {quoted(r.reason)}" for r in rules) + " END"


LENDING = ("credit-card", "mortgage", "personal-loan", "line-of-credit")
RATES, FEES, FLAGS = ("*_rate", "rate"), ("*_fee",), ("*_flag",)

# What pages are made of, and what can't be a field's value.
NAVIGATION = (
    "main navigation", "online banking", "find an atm", "find a branch", "about us", "contact us", "frequently asked questions", "calculators", "forms and documents", "credit cards", "chequing accounts", "savings accounts",
    "personal loans", "mortgages", "find your bdm", "get started", "tools and support", "advisor access", "marketing material", "workflows", "our accounts", "investment accounts", "mortgage loan calculator",
    "mortgage rates", "faqs", "investor relations", "careers", "bug bounty", "public accountability statement", "community news", "privacy & legal", "accessibility",
)
NAVIGATION_ALONE = ("home", "go to main content", "go to page content", "skip to main content", "document go to main content", "document go to page content", "document skip to main content", "learn more", "read more")
SKIPS = ("go to main content", "skip to main content")
OTHER_SECTIONS = ("our other products", "our other investment products", "other banking products", "related products")
PROMOTIONS = ("promotional rate", "promotional interest", "new client offer", "welcome offer", "special rate", "limited-time", "limited time")
SPENDING = ("direct deposit", "eligible deposit", "deposit today", "gift card", "cash bonus", "welcome bonus", "additional bonus", "purchase of", "spend $")
CALCULATORS = ("choose up to 4 banks to compare", "this calculator is for illustrative purposes only", "rates of the selected banks", "similar products at the select banks", "national average is based on")
PLAN_FEES = ("fee based on plan limits", "fee based on bank plan limits", "fee depends on the plan", "fee depends on the bank plan", "fees depend on the bank plan", "fees depend on the plan", "this will depend on the bank plan")
SECURITY = ("secured", "unsecured", "security requirement", "collateral", "guarantor", "co-signer", "cosigner", "pledge", "lien", "down payment")
OFFER_ENDS = ("offer valid until", "offer ends", "offer expires", "promotion ends", "promotion expires")
TAX = ("tax-free", "tax free", "tax-deferred", "tax deferred", "tax sheltered", "tax deduction", "taxable income", "tax benefit", "withholding tax", "income tax", "not taxed")
QUIZZES = ("still not sure", "let us help you decide", "answer a few quick questions", "we'll recommend the best", "we’ll recommend the best", "help me choose tool")
CALLS = ("book now", "call us", "ready to answer your questions", "assist you in opening an account", "schedule an appointment")
SIGN_ONS = ("must be registered for online", "need to register", "sign on to online banking", "sign in to online banking")
ACCESS, ACCESSING = ("mobile app", "online banking", "abm", "access card", "cheques"), ("funds can be accessed", "access your funds", "ways to access")
APPLYING = ("apply", "application", "open", "book an appointment", "speak to", "talk to")
PAGE_PARTS = ("interest rates", "resources", "legal", "about our", "sign on", "rate (%)", "apy (%)")
FEE_TABLES = ("monthly fee", "transactions included", "interest calculated", "paper or online statement", "minimum balance", "compare account")
BANK_ACCOUNTS, OWN_PRODUCTS = ("bank account", "chequing account", "savings account"), ("gic", "investment", "credit card", "mortgage", "loan", "line of credit")
FREQUENCIES = ("weekly", "biweekly", "bi-weekly", "semi-monthly", "monthly", "accelerated")
CALCULATED = ("calculated", "calculation", "accrues", "compounded", "paid monthly", "paid annually", "daily closing balance", "rate paid depends")
REPAYING = ("prepay", "pre-pay", "prepayment", "pre-payment", "repay", "penalty", "privilege")
INSURER_PAGES = ("contact us", "abm locator", "rates", "careers", "community", "get our app", "connect with us")
TITLES_ALONE = ("security requirement", "security requirements", "collateral", "what collateral is required", "is collateral required")
CONCISE = ("fees_text", "minimum_payment_text", "credit_limit_text", "monthly_payment_text", "rate_type", "payment_frequency", "security_requirement", "collateral_text", "deposit_insurance", "tax_benefits", "term_length_text", "prepayment_privileges")
OF_ACCOUNTS = ("included_transactions", "unlimited_transactions_flag", "overdraft_available_flag", "withdrawal_limit_text")
RETIREMENT, TAX_FREE = ("rsp", "rrsp", "rif", "retirement", "tax-deferred", "tax sheltered"), ("tfsa", "tax-free")

#: Columns that a rule can ask: field, family, name, v (value) and c (evidence) in lower case, number, and the flags of ``prepared``.
SUPPRESSIONS = (
    Rule("unresolved_placeholder", Flag("open_value")),
    Rule("other_product_section", Holds("c", *OTHER_SECTIONS)),
    Rule("unresolved_placeholder_in_evidence", Flag("number IS NOT NULL AND open_evidence"), RATES),
    Rule("expired_promotional_offer", Flag("number IS NOT NULL AND expired"), RATES),
    Rule("non_annual_return_context", Flag("number IS NOT NULL AND no_annual_rate"), RATES),
    Rule("implausible_annual_deposit_rate", Flag("number >= 10") & ~Is("family", *LENDING), RATES),
    Rule("promotional_evidence_of_a_standard_rate", Holds("c", *PROMOTIONS) | (Matches("c", "(for|during) (the )?(first )?[0-9]+[- ]?(day|month)") & Holds("c", "rate", "interest", "offer", "boost", "earn")), ("standard_rate", "base_12_month_rate")),
    Rule("percentage_not_in_evidence", Flag("number IS NOT NULL AND NOT stated") & ~(Flag("number = 0") & Holds("c", "no interest", "non-interest", "does not pay interest")), RATES),
    Rule("audience_of_a_legal_list", Is("v", "true") & Holds("c", "student", "youth", "senior", "newcomer", least=3) & Holds("c", "may not be available", "excludes", "such as", "including but not limited to"), ("student_plan_flag", "newcomer_plan_flag")),
    Rule("money_that_is_no_fee", Flag("spent"), FEES),
    Rule("copy_of_a_calculator", Holds("c", *CALCULATORS), ("minimum_balance", "interest_calculation_method")),
    Rule("fee_by_plan", Flag("number = 0") & Holds("c", *PLAN_FEES), FEES),
    Rule("fee_of_a_second_card", Flag("number = 0") & Holds("c", "authorized", "additional", "secondary") & Holds("c", "annual fee for") & ~Holds("c", "primary", "annual fee: $0", "annual fee $0", "no annual fee"), ("annual_fee",), ("credit-card",)),
    Rule("card_rate_without_its_label", ~Holds("c", "purchase"), ("purchase_interest_rate",), ("credit-card",)),
    Rule("card_rate_without_its_label", ~Holds("c", "balance transfer"), ("balance_transfer_rate",), ("credit-card",)),
    Rule("card_rate_without_its_label", ~Holds("c", "cash advance", "cash interest"), ("cash_advance_rate",), ("credit-card",)),
    Rule("rewards_of_a_low_rate_card", Holds("c", "lowest rate card", "low-interest credit card", "pay off your balance faster") & ~Holds("c", "reward", "points", "cash back", "cashback"), ("rewards_summary",), ("credit-card",)),
    Rule("security_without_evidence", ~Holds("c", *SECURITY), ("secured_flag", "security_requirement", "collateral_text")),
    Rule("end_of_an_offer_as_effective_date", Holds("c", *OFFER_ENDS), ("effective_date",)),
    Rule("field_of_another_family", Length("field"), OF_ACCOUNTS, ("gic",)),
    Rule("no_boolean", ~Is("v", "true", "false", "yes", "no", "1", "0"), FLAGS),
    Rule("navigation_copy", Is("v", *NAVIGATION_ALONE) | (Holds("v", *SKIPS) & Length("v", 0, 120)) | (Starts("v", "document ") & Words("v", below=5)) | (Length("v", 140) & Holds("v", *NAVIGATION, least=3))),
    Rule("offer_or_quiz_as_description", Is("v", "offer", "special offer", "welcome offer", "compare account", "compare accounts") | (Ends("v", ":") & Length("v", 0, 220)) | Holds("v", *QUIZZES) | Holds("v", *CALLS, least=2) | Starts("v", "to qualify for this offer", "to qualify for these offers", "open account"), ("description_short",)),
    Rule("description_of_another_type", Holds("v", "savings account") & ~Holds("v", "chequing", "checking"), ("description_short",), ("chequing",)),
    Rule("description_of_another_type", Holds("v", "chequing account", "checking account") & ~Holds("v", "savings", "interest rate"), ("description_short",), ("savings",)),
    Rule("no_rate", Length("v", 180) | (Length("v", 45) & ~Matches("v", "[0-9%]") & ~Holds("v", "prime")), RATES),
    Rule("instructions_as_eligibility", Holds("v", "to apply, you'll need", "to apply, you’ll need", "sign on", "what you need to know") | (Length("v", 80) & Ends("v", "an eligible")), ("eligibility_text", "eligibility")),
    Rule("no_tax_benefit", ~Holds("v", *TAX) | Holds("v", "special rate", "promotional rate", "new client offer"), ("tax_benefits",)),
    Rule("tax_of_another_plan", Holds("name", "rsp", "rrsp", "rif", "retirement") & Holds("v", *TAX_FREE) & ~Holds("v", *RETIREMENT), ("tax_benefits",), ("gic",)),
    Rule("tax_of_another_plan", Holds("name", *TAX_FREE) & Holds("v", *RETIREMENT) & ~Holds("v", *TAX_FREE), ("tax_benefits",), ("gic",)),
    Rule("one_of_several_frequencies", Is("v", "monthly", "quarterly", "semi-annually", "annually", "at_maturity") & Holds("c", " monthly", " quarterly", " annually", "at maturity", least=2), ("compounding_frequency", "interest_payment_frequency", "payout_option")),
    Rule("frequency_of_payments", Is("v", "weekly", "biweekly", "bi-weekly", "monthly", "semi-monthly") & Holds("c", "payment frequency") & ~Holds("c", "interest payment", "interest is paid", "interest compounded", "interest compounds"), ("compounding_frequency", "interest_payment_frequency", "payout_option")),
    Rule("no_payment_frequency", Length("v", 101) | Holds("v", "calculator", "prepayment", "pre-payment", "special offers") | ~Holds("v", *FREQUENCIES), ("payment_frequency",)),
    Rule("no_amortization", Length("v", 161) | ~Matches("v", "[0-9] *(year|month)"), ("amortization_text",)),
    Rule("no_way_to_apply", Holds("v", *SIGN_ONS) | (Holds("v", *ACCESS) & Holds("c", *ACCESSING) & ~Holds("v", *APPLYING)) | (Length("v", 180) & Holds("v", *PAGE_PARTS, least=3)) | Holds("v", *FEE_TABLES, least=3) | Starts("v", "how do i apply"), ("application_method",)),
    Rule("way_to_another_product", Holds("v", *BANK_ACCOUNTS) & ~Holds("v", *OWN_PRODUCTS), ("application_method",), ("gic", *LENDING)),
    Rule("no_fees", Is("v", "monthly fees free", "monthly fee free") | ~Holds("v", "fee", "charge", "cost") | (Holds("v", "penalty free", "penalty-free", "without penalty", "prepay", "repay") & ~Holds("v", "fee", "$")), ("fees_text",), LENDING),
    Rule("no_payment", ~Holds("v", "payment", "repay") | (Holds("v", "calculate", "see how much", "estimate your") & ~Matches("v", "[$0-9]") & ~Holds("v", *FREQUENCIES)), ("monthly_payment_text",), LENDING),
    Rule("no_payment", ~Holds("v", "payment", "pay at least", "repay", "interest-only", "interest only", "interest and principal", "principal and interest"), ("minimum_payment_text",), LENDING),
    Rule("no_amount", Length("v", 101) & ~Matches("v", "[$0-9]") & ~Holds("v", "minimum", "maximum", "up to"), ("loan_amount_text",), LENDING),
    Rule("title_alone", Is("v", *TITLES_ALONE), ("security_requirement", "collateral_text"), LENDING),
    Rule("no_privilege", ~Holds("v", *REPAYING), ("prepayment_privileges",), LENDING),
    Rule("no_method", ~Holds("v", *CALCULATED), ("interest_calculation_method",)),
    Rule("legal_notes", Starts("v", "legal footnote", "legal disclaimer", "footnote details") | Holds("v", "other conditions and exceptions may apply"), ("notes",)),
    Rule("page_of_an_insurer", Holds("v", *INSURER_PAGES, least=3), ("deposit_insurance",)),
    Rule("page_copy", Length("v", 240), CONCISE),
)

#: Why a text can't be its field's value, whatever the product and the evidence: asked when a reviewer looks at it.
NOISE = (
    Rule("cta_copy", Starts("v", "see ", "view ", "check ") & Matches("v", "^.{0,57} rates?( |$)"), ("product_name",)),
    Rule("unresolved_placeholder", Flag("open_value")),
    Rule("navigation_copy", Is("v", *NAVIGATION_ALONE) | (Starts("v", "document ") & Words("v", below=5)) | (Length("v", 140) & Holds("v", *NAVIGATION, least=3))),
    Rule("page_copy", Length("v", 150), RATES),
    Rule("non_value_copy", Length("v", 45) & ~Matches("v", "[0-9%]") & ~Holds("v", "prime"), RATES),
    Rule("non_value_copy", Starts("v", "how do i apply"), ("application_method",)),
    Rule("non_value_copy", Length("v", 101) | Holds("v", "calculator", "prepayment", "pre-payment", "special offers") | ~Holds("v", *FREQUENCIES), ("payment_frequency",)),
    Rule("non_value_copy", Length("v", 161) | ~Matches("v", "[0-9] *(year|month)"), ("amortization_text",)),
    Rule("page_copy", Length("v", 240), CONCISE),
)


def lowered(x: Column) -> Column:
    return F.lower(tx.collapsed(F.coalesce(x, F.lit(""))))


# What an excerpt says for the value of a field, beside its words: (fields, test, points), all that hold count. Columns: x, and zero (the value is 0).
_FEE, _CONDITIONAL = ("monthly_fee", "public_display_fee"), ("as low as", "rebate")
_LIMITED, _MORE = ("first 3 months", "for the first", "limited time", "limited-time"), ("extra", "additional")
SEMANTIC = (
    (_FEE, Holds("x", "standard monthly fee", "monthly fee is", "monthly fee:", "monthly account fee is", "monthly account fee:"), 8),
    (_FEE, Holds("x", *_CONDITIONAL, "eligible for no monthly fee"), -5),
    (_FEE, Flag("zero") & Holds("x", *_CONDITIONAL), -10),
    (_FEE, Flag("zero") & Holds("x", "no monthly fee", "no fee", "$0") & Holds("x", "when you", "if you", "maintain", "minimum balance of"), -14),
    (("unlimited_transactions_flag",), Holds("x", "unlimited debit transactions"), 8),
    (("promotional_rate",), Holds("x", "total interest rate including promo"), 14),
    (("promotional_rate",), Holds("x", "earn ") & Matches("x", "[0-9] ?%") & Holds("x", *_LIMITED), 10),
    (("promotional_rate",), Holds("x", *_MORE, "bonus interest rate") & ~Holds("x", "total interest rate", "promotional interest rate"), -5),
    (("public_display_rate",), Holds("x", "total interest rate including promo", "earn up to"), 12),
    (("public_display_rate",), Holds("x", "interest rate with bonus"), 9),
    (("public_display_rate",), Holds("x", *_MORE) & ~Holds("x", "total interest rate"), -4),
    (("eligibility_text",), Holds("x", "eligibility", "here's how to qualify", "here is how to qualify"), 8),
    (("eligibility_text",), Holds("x", "maintain an eligible", "maintain a eligible") & Holds("x", "complete at least") & Matches("x", "[0-9]+ (out )?of (the )?[0-9]+ qualifying"), 16),
    (("eligibility_text",), Holds("x", "could earn") & Holds("x", "when you start with an eligible"), -4),
)


def points(table=SEMANTIC) -> Column:
    return reduce(lambda a, b: a + b, [F.when(Rule("", test, fields).whole().spark(), n).otherwise(0) for fields, test, n in table])


def points_sql(table=SEMANTIC) -> str:
    return "(" + " + ".join(f"CASE WHEN {Rule('', test, fields).whole().sql()} THEN {n} ELSE 0 END" for fields, test, n in table) + ")"


# What a chunk (x) says for a field by its name (n): the first that holds counts. (parts of the name, test, bonus)
SIGNALS = (
    ("rate", Holds("x", "%"), 0.62),
    ("rate", Holds("x", "interest"), 0.18),
    ("fee", Holds("x", "fee", "$"), 0.18),
    ("balance", Holds("x", "no minimum balance"), 0.5),
    ("balance", Holds("x", "balance"), 0.18),
    ("eligibility", Holds("x", "eligible", "qualify"), 0.18),
    ("application_method", Holds("x", "apply", "open account", "online", "branch", "mobile app"), 0.18),
    ("maturity", Holds("x", "maturity", "renewal", "reinvest"), 0.18),
    ("tax", Holds("x", "tax", "tfsa", "rrsp", "registered"), 0.18),
    ("insurance", Holds("x", "cdic", "insured", "deposit insurance"), 0.18),
    ("term_rate_table", Holds("x", "%") & Holds("x", "term", "month", "year"), 0.18),
    ("payment_frequency", Holds("x", "monthly"), 0.18),
    ("calculation_method", Holds("x", "calculated"), 0.18),
    ("term_length", Holds("x", "term", "year", "month", "day"), 0.18),
    ("redeemable", Holds("x", "redeemable", "cashable"), 0.18),
    ("compounding", Holds("x", "compounded", "compound interest"), 0.18),
    ("payout_option", Holds("x", "paid", "maturity", "interest paid"), 0.18),
    ("registered", Holds("x", "tfsa", "rrsp", "rrif", "registered"), 0.18),
    ("transactions", Holds("x", "transaction", "debit", "unlimited"), 0.18),
    ("transfer", Holds("x", "free", "included", "unlimited", "no fee", "no-fee") & Holds("x", "e-transfer", "e transfer", "etransfer"), 0.5),
    ("transfer", Holds("x", "e-transfer", "interac"), 0.18),
    ("overdraft", Holds("x", "overdraft"), 0.18),
    ("cheque", Holds("x", "cheque", "check"), 0.18),
    ("student_plan_flag", Holds("x", "student", "youth"), 0.18),
    ("newcomer_plan_flag", Holds("x", "newcomer", "new to canada"), 0.18),
)
NO_SIGNAL = 0.05


def signal() -> Column:
    """The bonus of the first signal between columns ``field`` and ``x``."""
    out = None
    for part, test, bonus in SIGNALS:
        both = (Holds("field", part) & test).spark()
        out = F.when(both, bonus) if out is None else out.when(both, bonus)
    return out.otherwise(NO_SIGNAL)


def signal_sql() -> str:
    return "CASE " + " ".join(f"WHEN {(Holds('field', part) & test).sql()} THEN {bonus}" for part, test, bonus in SIGNALS) + f" ELSE {NO_SIGNAL} END"
