"""What becomes of a validated candidate: the first gate that keeps it from being published, and what a reviewer should look at.

Gates and categories are tables in their order; the first that holds counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import contracts, fieldrules, rates
from quarrystone.functions import text as tx
from quarrystone.operators import gates, profiles
from quarrystone.operators.quality import first_match

# Issues that keep no candidate from being published, and what a page of no product is called.
NOT_BLOCKING = ("partial_source_failure", "low_confidence")
NAMES_WITHIN = ("calculator", "search tool", "benefits of", "benefits on", "benefits for", "benefit of", "benefit on", "benefit for")
NAMES_WHOLE = ("account fee", "account fees", "include in any bank plan")
NAMES_BEGIN = ("better banking", "save smarter", "banking for", "a chequing account", "a checking account", "a bank account")
PAGES = ("editorial_page", "servicing_page", "article", "help_page")
#: Gates in order, and what a candidate that fails one becomes.
ACTIONS = {
    "force_review_issue_code": "queued_for_review", "comparison_fields_missing": "queued_for_review", "ai_grounding_insufficient": "queued_for_review", "source_role_missing": "queued_for_review",
    "non_detail_source_role": "rejected", "non_product_source": "rejected", "ambiguous_product_boundary": "queued_for_review", "non_product_name": "rejected",
}


def no_product_name(name: Column) -> Column:
    """Whether a name is that of a page: a tool, a list of benefits, a slogan, a call to see rates."""
    x = fieldrules.lowered(name)
    begins = lambda *words: reduce(lambda a, b: a | b, [x.startswith(w) for w in words])
    within = reduce(lambda a, b: a | b, [x.rlike(rf"\b{w}\b") for w in NAMES_WITHIN])
    return within | x.isin(*NAMES_WHOLE) | begins(*NAMES_BEGIN) | (begins("see ", "view ", "check ") & x.rlike("^.{0,57} rates?( |$)"))


def _has(column: str, *codes: str) -> Column:
    return F.arrays_overlap(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: F.lower(F.trim(r))), F.array(*map(F.lit, codes)))


def promoted(candidates: DataFrame, force_review: list[str]) -> DataFrame:
    """``candidates`` with skip_reason and action (promoted where no gate holds).

    Columns: codes, applicable, contract_defined and complete (of ``profiles.quality``), dynamic
    (a type that isn't known, which needs grounding), grounded, source_role, reasons, product_name.
    """
    forced = [c for c in force_review if c not in NOT_BLOCKING]
    role = F.lower(F.trim(F.coalesce("source_role", F.lit(""))))
    tests = {
        "force_review_issue_code": F.arrays_overlap("codes", F.array(*map(F.lit, forced)).cast("array<string>")),
        "comparison_fields_missing": F.col("applicable") & (~F.col("contract_defined") | ~F.col("complete")),
        "ai_grounding_insufficient": F.col("dynamic") & ~F.coalesce("grounded", F.lit(False)),
        "source_role_missing": role == "",
        "non_detail_source_role": role != "detail",
        "non_product_source": _has("reasons", *PAGES),
        "ambiguous_product_boundary": _has("reasons", "multi_product_family_overview"),
        "non_product_name": no_product_name(F.col("product_name")),
    }
    reason = first_match([(F.coalesce(tests[name], F.lit(False)), name) for name in ACTIONS])
    action = first_match([(F.col("skip_reason") == name, what) for name, what in ACTIONS.items()], "promoted")
    return candidates.withColumn("skip_reason", reason).withColumn("action", action)


def suspects(candidates: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, field, issue) of payload texts that can't be their fields' values, of long texts in several fields, and of days against words."""
    entries = F.map_entries(F.try_parse_json(payload).try_cast("map<string, variant>"))
    each = candidates.select(key, F.inline(entries)).withColumnRenamed("key", "field").where(contracts.kind_of_variant(F.col("value")).isin("string", "integer"))
    text = each.select(key, "field", F.col("value").try_cast("string").alias("value")).withColumn("v", fieldrules.lowered(F.col("value"))).withColumn("open_value", rates.placeholder(F.col("v")))
    copy = F.regexp_replace("v", r"^[ .:;|_-]+|[ .:;|_-]+$", "")
    same, own = Window.partitionBy(key, "copy"), Window.partitionBy(key)
    text = text.withColumn("copy", F.when(F.length(copy) >= 80, F.sha2(copy, 256)).otherwise(F.col("field"))).withColumn("copies", F.count("*").over(same)).withColumn("described", F.max(F.col("field") == "description_short").over(same))
    text = text.withColumn("words", F.max(F.when(F.col("field") == "term_length_text", F.col("value"))).over(own))
    days = (F.col("field") == "term_length_days") & F.coalesce(gates.term_conflict(tx.number(F.col("value")).cast("int"), F.col("words")), F.lit(False))
    issue = F.when(days, "cross_field_conflict").when((F.col("copies") > 1) & ~(F.col("described") & (F.col("field") == "description_short")), "duplicated_page_copy").otherwise(fieldrules.first_reason(fieldrules.NOISE))
    return text.select(key, "field", issue.alias("issue")).where("issue IS NOT NULL")


CATEGORIES = {
    "non_product_source": ("This source does not show one product.", "reject"),
    "ambiguous_product_boundary": ("This page holds several products that one proposal can't stand for.", "defer"),
    "suspect_fields": (None, "edit_approve"),
    "missing_fields": (None, "edit_approve"),
    "validation_error": ("Validation found an error; the source has to be looked at.", "edit_approve"),
    "evidence_review": ("Hold the proposed values against the source.", "approve"),
}


def diagnosed(candidates: DataFrame, key: str, payload: str) -> DataFrame:
    """``candidates`` (codes, validation_status, missing, source_role, reasons, ...) with category, headline, recommended_action and affected (field, label, issue), missing fields first."""
    found = suspects(candidates, key, payload).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("field", "issue"))).alias("_suspects"))
    df = candidates.join(found, F.col(key) == F.col("_key"), "left")
    label = lambda f: F.initcap(F.translate(f, "_", " "))
    none = F.array().cast("array<struct<field: string, issue: string>>")
    missing = F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda f: F.struct(f.alias("field"), F.lit("missing").alias("issue")))
    suspect = F.filter(F.coalesce("_suspects", none), lambda s: ~F.array_contains(F.coalesce("missing", F.array().cast("array<string>")), s["field"]))
    all_ = F.transform(F.concat(missing, suspect), lambda s: F.struct(s["field"].alias("field"), label(s["field"]).alias("label"), s["issue"].alias("issue")))
    role = F.lower(F.trim(F.coalesce("source_role", F.lit("unknown"))))
    category = first_match([
        (~role.isin("detail", "unknown") | F.coalesce(_has("reasons", *PAGES), F.lit(False)), "non_product_source"),
        (F.array_contains("codes", "ambiguous_product_boundary") | F.coalesce(_has("reasons", "multi_product_family_overview"), F.lit(False)), "ambiguous_product_boundary"),
        (F.size(F.coalesce("_suspects", none)) > 0, "suspect_fields"), (F.size(missing) > 0, "missing_fields"), (F.col("validation_status") == "error", "validation_error"),
    ], "evidence_review")
    n = F.size("affected")
    fields = F.concat(n.cast("string"), F.when(F.col("category") == "missing_fields", " required").otherwise(""), F.when(n == 1, " field").otherwise(" fields"))
    counted = F.when(F.col("category") == "suspect_fields", F.concat(fields, F.when(n == 1, " needs").otherwise(" need"), F.lit(" attention."))).when(F.col("category") == "missing_fields", F.concat(fields, F.when(n == 1, " is").otherwise(" are"), F.lit(" missing.")))
    df = df.withColumn("category", category).withColumn("affected", F.when(F.col("category").isin("non_product_source", "ambiguous_product_boundary"), F.slice(all_, 1, 0)).otherwise(all_))
    headline = F.coalesce(counted, first_match([(F.col("category") == c, text) for c, (text, _) in CATEGORIES.items() if text]))
    action = F.when((F.col("category") == "validation_error") & F.array_contains("codes", "conflicting_evidence"), "defer").otherwise(first_match([(F.col("category") == c, what) for c, (_, what) in CATEGORIES.items()]))
    return df.withColumn("headline", headline).withColumn("recommended_action", action).drop("_key", "_suspects")


def with_quality(candidates: DataFrame) -> DataFrame:
    """``candidates`` with what their market asks, and whether their type is one that no market knows."""
    known = F.lower(F.trim("product_type")).isin(*sorted({kind for _, kind in profiles.PROFILES}))
    return profiles.quality(candidates, "payload", "expected").withColumn("dynamic", ~F.coalesce(known, F.lit(False)))
