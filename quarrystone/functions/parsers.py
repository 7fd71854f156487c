r"""Values of product fields read from sentences: a table of parsers, rendered for Spark and for SQL.

A parser looks at one sentence (``s`` in lower case, ``o`` as it stands). It asks for a label
among the sentence's words, for none of the words that speak against it, and takes a value
beside the label. Parsers of one field stand in order: the first that finds a value in any
sentence gives it, and of its sentences the first.
"""

from __future__ import annotations


from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.fieldrules import Holds, quoted

MONEY, PERCENT, COUNT = r"\$ ?([0-9][0-9,]*(?:\.[0-9]{1,2})?)", r"([0-9]{1,3}(?:\.[0-9]{1,4})?) ?%", r"([0-9]{1,3})"
#: Where a text is cut into sentences.
ENDS = r"\. |\.$|[\n;|•]"


class Take:
    """What of a sentence is the value: text, or null where there is none."""

    def spark(self, labels: tuple[str, ...]) -> Column:
        raise NotImplementedError

    def sql(self, labels: tuple[str, ...]) -> str:
        raise NotImplementedError


class Beside(Take):
    """A figure behind a label with no other figure of its kind between, or else one ahead of a label."""

    def __init__(self, figure: str, sign: str, gap: int = 60):
        self.figure, self.sign, self.gap = figure, sign, gap

    def patterns(self, labels):
        any_ = "(?:" + "|".join(labels) + ")"
        return f"{any_}[^{self.sign}]{{0,{self.gap}}}?{self.figure}", f"{self.figure}[^{self.sign}]{{0,{self.gap}}}?{any_}"

    def spark(self, labels):
        return F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract("s", p, 1), ",", ""), F.lit("")) for p in self.patterns(labels)))

    def sql(self, labels):
        return "coalesce(" + ", ".join(f"nullif(replace(regexp_extract(s, {quoted(p)}, 1), ',', ''), '')" for p in self.patterns(labels)) + ")"


class Found(Take):
    """What a pattern finds, wherever the label stands."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def spark(self, labels):
        return F.nullif(F.regexp_extract("s", self.pattern, 1), F.lit(""))

    def sql(self, labels):
        return f"nullif(regexp_extract(s, {quoted(self.pattern)}, 1), '')"


class Fixed(Take):
    """A value that the label itself gives."""

    def __init__(self, value: str):
        self.value = value

    def spark(self, labels):
        return F.lit(self.value)

    def sql(self, labels):
        return quoted(self.value)


class Sentence(Take):
    """The sentence as it stands."""

    def spark(self, labels):
        return F.trim("o")

    def sql(self, labels):
        return "trim(o)"


class OneOf(Take):
    """The first of some words, in their order, that the sentence holds."""

    def __init__(self, words: dict[str, str]):
        self.words = words

    def spark(self, labels):
        return F.coalesce(*(F.when(F.col("s").contains(w), v) for w, v in self.words.items()))

    def sql(self, labels):
        return "CASE " + " ".join(f"WHEN contains(s, {quoted(w)}) THEN {quoted(v)}" for w, v in self.words.items()) + " END"


class Parser(NamedTuple):
    field: str
    take: Take
    labels: tuple[str, ...]
    against: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    also: tuple[str, ...] = ()

    def test(self):
        out = Holds("s", *self.labels)
        if self.also:
            out = out & Holds("s", *self.also)
        if self.against:
            out = out & ~Holds("s", *self.against)
        if self.families:
            out = out & Holds("family", *self.families)
        return out

    def spark(self) -> Column:
        return F.when(self.test().spark(), self.take.spark(self.labels))

    def sql(self) -> str:
        return f"CASE WHEN {self.test().sql()} THEN {self.take.sql(self.labels)} END"


_MONEY, _PERCENT = Beside(MONEY, "$"), Beside(PERCENT, "%")
_PROMO = ("promotional", "promo", "introductory", "intro", "welcome", "special rate", "limited time", "limited-time", "bonus", "first ")
_WAIVED = ("waive", "rebate", "when you maintain", "if you maintain", "as low as")
FREQUENCIES = {"at maturity": "at_maturity", "semi-annual": "semi-annually", "semi annual": "semi-annually", "quarterly": "quarterly", "monthly": "monthly", "annual": "annually", "daily": "daily"}
PAYMENTS = {"bi-weekly": "biweekly", "biweekly": "biweekly", "weekly": "weekly", "semi-monthly": "semi-monthly", "monthly": "monthly"}
#: In their order by field: labels of the field itself, then what else tells its value.
PARSERS = (
    Parser("monthly_fee", _MONEY, ("monthly fee", "monthly account fee", "monthly plan fee"), (*_WAIVED, "paper statement")),
    Parser("monthly_fee", _MONEY, ("per month", "a month", "/month"), (*_WAIVED, "transaction", "deposit", "earn", "payment")),
    Parser("monthly_fee", Fixed("0"), ("no monthly fee", "no monthly account fee", "free account", "$0 monthly"), (*_WAIVED, "if you", "when you")),
    Parser("fee_waiver_condition", Sentence(), ("waive", "rebate"), (), (), ("monthly fee", "account fee", "plan fee")),
    Parser("fee_waiver_condition", Sentence(), ("no monthly fee",), (), (), ("if you", "when you", "with a minimum", "maintain")),
    Parser("minimum_balance", _MONEY, ("minimum balance", "minimum daily balance", "minimum monthly balance"), ("deposit",)),
    Parser("minimum_balance", Fixed("0"), ("no minimum balance", "no minimum monthly balance")),
    Parser("minimum_deposit", _MONEY, ("minimum deposit", "minimum investment", "minimum opening deposit", "opening deposit")),
    Parser("minimum_deposit", _MONEY, ("as little as", "start with", "open with", "invest from"), (), ("gic", "savings")),
    Parser("minimum_deposit", Fixed("0"), ("no minimum deposit", "no minimum investment", "no minimum to open")),
    Parser("included_transactions", Found(r"([0-9]{1,3}) (?:free |everyday |debit |included )*transactions"), ("transactions",), ("additional", "extra"), ("chequing", "savings")),
    Parser("unlimited_transactions_flag", Fixed("true"), ("unlimited transactions", "unlimited debit transactions", "unlimited everyday transactions", "unlimited debits"), ("not unlimited",)),
    Parser("transaction_fee", _MONEY, ("per transaction", "each transaction", "additional transaction", "each additional"), ("e-transfer", "atm", "abm")),
    Parser("interac_e_transfer_included", Fixed("true"), ("e-transfer", "e transfer"), ("fee of", "each"), (), ("free", "unlimited", "included", "no fee", "no-fee")),
    Parser("overdraft_available", Fixed("true"), ("overdraft protection", "overdraft available", "overdraft coverage"), ("no overdraft", "not available")),
    Parser("promotional_rate", _PERCENT, ("promotional rate", "promotional interest rate", "promo rate", "introductory rate", "special rate", "welcome rate"), ("extra", "additional")),
    Parser("promotional_rate", _PERCENT, ("earn",), ("extra", "additional"), ("savings", "chequing"), ("first ", "limited time", "limited-time")),
    Parser("promotional_period_text", Found(r"((?:for|during) (?:the |your )?(?:first )?[0-9]{1,3} (?:days|months|weeks))"), _PROMO),
    Parser("standard_rate", _PERCENT, ("standard rate", "regular rate", "standard interest rate", "regular interest rate", "base rate"), _PROMO, ("savings", "chequing", "gic")),
    Parser("standard_rate", _PERCENT, ("interest rate", "annual rate", "apy"), _PROMO, ("savings", "chequing", "gic")),
    Parser("purchase_interest_rate", _PERCENT, ("purchase rate", "purchase interest rate", "purchases", "purchase apr"), (*_PROMO, "cash advance", "balance transfer"), ("credit-card",)),
    Parser("cash_advance_rate", _PERCENT, ("cash advance",), _PROMO, ("credit-card",)),
    Parser("balance_transfer_rate", _PERCENT, ("balance transfer",), _PROMO, ("credit-card",)),
    Parser("purchase_interest_rate_summary", Sentence(), ("purchase",), ("cash advance", "balance transfer"), ("credit-card",), ("% to", "% - ", "% – ", "% variable", "variable apr")),
    Parser("annual_fee", _MONEY, ("annual fee",), ("additional card", "authorized user", "secondary", "first year", "rebate"), ("credit-card",)),
    Parser("annual_fee", Fixed("0"), ("no annual fee",), ("first year",), ("credit-card",)),
    Parser("mortgage_rate", _PERCENT, ("mortgage rate", "fixed rate", "variable rate"), ("prime", "discount", "down payment", "reference"), ("mortgage",)),
    Parser("interest_rate", _PERCENT, ("interest rate", "rate of", "apr"), ("prime", "discount", "reference"), ("personal-loan", "line-of-credit")),
    Parser("interest_rate_summary", Sentence(), ("interest rate", "prime rate", "prime +", "prime plus", "apr"), (), ("mortgage", "personal-loan", "line-of-credit")),
    Parser("rate_type", OneOf({"variable": "variable", "fixed": "fixed"}), ("variable rate", "fixed rate", "variable interest", "fixed interest"), (), ("mortgage", "personal-loan", "line-of-credit")),
    Parser("amortization_text", Found(r"(?:amortization|amortize|amortized)[^0-9]{0,40}([0-9]{1,3} ?(?:years|year|months))"), ("amortiz",), (), ("mortgage", "personal-loan")),
    Parser("term_length_text", Found(r"([0-9]{1,3}(?:\.[0-9])?[ -](?:years?|months?|days?))"), ("term",), ("first ", "promo")),
    Parser("redeemable_flag", Fixed("false"), ("non-redeemable", "non redeemable", "not redeemable", "cannot be redeemed", "non-cashable"), (), ("gic",)),
    Parser("redeemable_flag", Fixed("true"), ("redeemable", "cashable", "redeem any time", "redeem at any time"), (), ("gic",)),
    Parser("non_redeemable_flag", Fixed("true"), ("non-redeemable", "non redeemable", "not redeemable", "cannot be redeemed", "non-cashable"), (), ("gic",)),
    Parser("registered_plan_supported", Fixed("true"), ("tfsa", "rrsp", "rrif", "resp", "registered plan", "registered account"), ("not available", "non-registered"), ("gic", "savings")),
    Parser("compounding_frequency", OneOf(FREQUENCIES), ("compounded", "compounds"), ("or at maturity", "monthly or", "annually or")),
    Parser("interest_payment_frequency", OneOf(FREQUENCIES), ("interest is paid", "interest paid", "pays interest", "paid monthly", "paid annually"), ("monthly or", "annually or", "or at maturity")),
    Parser("interest_calculation_method", Sentence(), ("interest is calculated", "calculated daily", "interest calculated", "simple interest")),
    Parser("payment_frequency", OneOf(PAYMENTS), ("payment frequency", "payments", "pay weekly"), ("calculator", "prepay"), ("mortgage", "personal-loan")),
    Parser("prepayment_privileges", Sentence(), ("prepay", "pre-pay", "prepayment"), ("calculator",), ("mortgage", "personal-loan")),
    Parser("credit_limit_text", Sentence(), ("credit limit", "borrow up to", "limit of $"), (), ("line-of-credit", "credit-card")),
    Parser("loan_amount_text", Sentence(), ("loan amount", "borrow", "loans from", "loans of"), (), ("personal-loan",), ("$",)),
    Parser("minimum_payment_text", Sentence(), ("minimum payment", "interest only", "interest-only"), (), ("line-of-credit", "credit-card")),
    Parser("secured_flag", Fixed("false"), ("unsecured",), (), ("line-of-credit", "personal-loan")),
    Parser("secured_flag", Fixed("true"), ("secured",), (), ("line-of-credit", "personal-loan")),
    Parser("eligibility_text", Sentence(), ("eligib", "to qualify", "must be", "age of majority", "who can apply"), ("eligible purchase", "offer")),
    Parser("application_method", Sentence(), ("apply online", "open online", "open an account online", "visit a branch", "at a branch", "in branch", "by phone", "book an appointment"), ("sign in",)),
    Parser("deposit_insurance", Sentence(), ("cdic", "deposit insurance", "fdic", "deposit guarantee"), ("contact us", "careers")),
    Parser("tax_benefits", Sentence(), ("tax-free", "tax free", "tax-deferred", "tax deferred", "tax sheltered")),
    Parser("student_plan_flag", Fixed("true"), ("student", "youth"), ("not available", "excludes", "except"), ("chequing", "savings"), ("account for", "plan for", "for students", "free for", "discount")),
    Parser("newcomer_plan_flag", Fixed("true"), ("newcomer", "new to canada"), ("not available", "excludes", "except"), ("chequing", "savings")),
)


def found() -> Column:
    """(field, step, value) of every parser that finds something in the sentence of a row (s, o, family)."""
    each = [F.struct(F.lit(p.field).alias("field"), F.lit(n).alias("step"), p.spark().alias("value")) for n, p in enumerate(PARSERS)]
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull())


def found_sql() -> str:
    each = ", ".join(f"{{'field': '{p.field}', 'step': {n}, 'value': {p.sql()}}}" for n, p in enumerate(PARSERS))
    return f"[x for x in [{each}] if x.value IS NOT NULL]"


def fields() -> tuple[str, ...]:
    return tuple(dict.fromkeys(p.field for p in PARSERS))


