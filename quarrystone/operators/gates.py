"""Gates between evidence and publication: retrieval, grounding, scenarios, confidence, assembly. Each is decided inside a row or by one aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import fieldrules
from quarrystone.functions import text as tx
from quarrystone.operators.quality import first_match


def filtered(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """Rows under all metadata filters; an empty one lets all pass."""
    for column, values in wanted.items():
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def hybrid(chunks: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, chunk_id, score, mode) of every chunk (x, its text in lower case, tokens, anchor, vector_score) and field (keys, words, phrases).

    The fields are a list in the code; chunks stay where they are. A chunk without a vector score keeps its lexical one.
    """
    overlap = F.size(F.array_intersect(F.array_distinct("tokens"), "words"))
    phrases = F.size(F.filter("phrases", lambda p: F.col("x").contains(p)))
    anchors = F.size(F.filter("keys", lambda k: F.coalesce(F.col("anchor"), F.lit("")).contains(k)))
    lexical = F.least(F.lit(0.99), F.least(F.lit(0.55), 0.12 * overlap) + F.least(F.lit(0.25), 0.12 * phrases) + F.least(F.lit(0.1), 0.05 * anchors) + fieldrules.signal())
    vector = F.col("vector_score")
    score = F.when(vector.isNull(), lexical).otherwise(F.least(F.lit(0.99), 0.55 * lexical + 0.45 * F.greatest(F.lit(0.0), F.least(F.lit(0.99), vector))))
    return chunks.crossJoin(F.broadcast(fields)).select("field", "chunk_id", F.round(score, 4).alias("score"), F.when(vector.isNull(), "metadata-only").otherwise("vector-assisted").alias("mode"))


def grounded(quote: Column, excerpt: Column) -> Column:
    """Whether a quote of eight characters or more, without an ellipsis, stands in the excerpt, whatever the case and spacing."""
    q = F.lower(tx.collapsed(quote))
    return (F.length(q) >= 8) & ~q.contains("...") & ~q.contains("…") & F.lower(tx.collapsed(excerpt)).contains(q)


def preserved(summary: Column, evidence: Column, groups: list[list[str]]) -> Column:
    """Whether the summary holds one of each group of markers of which the evidence holds one; an empty text has nothing to lose."""
    s, e = (F.coalesce(F.lower(tx.collapsed(x)), F.lit("")) for x in (summary, evidence))
    holds = lambda x, group: reduce(lambda a, b: a | b, [x.contains(m) for m in group])
    return (s == "") | (e == "") | reduce(lambda a, b: a & b, [~holds(e, g) | holds(s, g) for g in groups])


def as_of(evidence: Column) -> Column:
    """The day on which a rate's evidence says that it was read; null where it is none."""
    parts = [F.regexp_extract(evidence, r"(?i)\brates?\b[^.;:\n]{0,45}?\bas\s+of\s+(\d{4})-(\d{1,2})-(\d{1,2})\b", k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date"))


def term_conflict(days: Column, words: Column) -> Column:
    """Whether ``days`` fits none of the terms in ``words``: within 8 % or 7 days of one, or between the least and the most."""
    pattern = r"(\d{1,3})\s*(day|month|year)s?\b"
    amounts, units = (F.regexp_extract_all(F.lower(words), F.lit(pattern), F.lit(k)) for k in (1, 2))
    terms = F.transform(F.arrays_zip(amounts.alias("n"), units.alias("u")), lambda z: z["n"].cast("int") * F.when(z["u"] == "day", 1).when(z["u"] == "month", 30).otherwise(365))
    near = F.exists(terms, lambda t: F.abs(days - t) <= F.greatest(F.lit(7), F.round(t * 0.08)))
    return (F.size(terms) > 0) & ~near & ~((F.size(terms) > 1) & days.between(F.array_min(terms), F.array_max(terms)))


def out_of_range(value: Column, least: float, most: float | None) -> Column:
    """Whether a value is there and lies below ``least`` or from ``most`` on."""
    test = value < least
    return F.coalesce(test if most is None else test | (value >= most), F.lit(False))


def labelled(code: Column, messages: dict[str, str]) -> Column:
    """The message of a code, or the code in words."""
    return first_match([(code == k, v) for k, v in messages.items()]).otherwise(F.translate(code, "_", " "))


def completeness(fields: list[str], bonus: Column) -> Column:
    """The share of fields that are there, a tenth more where the type's own field is."""
    there = reduce(lambda a, b: a + b, [F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1).otherwise(0) for f in fields])
    return F.least(F.lit(1.0), there / F.lit(float(len(fields))) + F.when(bonus, 0.1).otherwise(0.0))


def confidence(complete: Column, evidence: Column, fields: Column, ambiguous: Column, status: Column, conflicting: Column) -> Column:
    """Weighted completeness, evidence, coverage, mapping and parsing, less penalties, between 0 and 0.99."""
    minus = lambda test, n: F.when(test, n).otherwise(0.0)
    score = 0.28 * complete + 0.28 * F.coalesce(evidence, F.lit(0.4)) + 0.16 * F.least(F.lit(1.0), F.coalesce(fields, F.lit(0)) / 8.0) + 0.14 * (0.92 - minus(ambiguous, 0.15)) + 0.14 * 0.95
    score = score - minus(status == "warning", 0.08) - minus(status == "error", 0.2) - minus(conflicting, 0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), score))


def grounding(fields: DataFrame, key: str, name: str, threshold: float, least: int = 2) -> DataFrame:
    """(key, verified_ratio, reason_codes) from one row per field (field, verified): the name, ``least`` fields and a share of all must be verified."""
    sums = fields.groupBy(key).agg(F.count("*").alias("n"), F.count_if("verified").alias("v"), F.max(F.coalesce(F.col("verified") & (F.col("field") == name), F.lit(False))).alias("named"))
    ratio = F.col("v") / F.col("n")
    reasons = F.concat_ws(",", F.when(~F.col("named"), "product_identity_unverified"), F.when(F.col("v") < least, "verified_field_count_below_minimum"), F.when(ratio < threshold, "verified_field_ratio_below_threshold"))
    return sums.select(key, F.round(ratio, 6).alias("verified_ratio"), reasons.alias("reason_codes"))


# The currency of a country.
CURRENCY = {"CA": "CAD", "US": "USD", "JP": "JPY", "KR": "KRW"}


def assembled(product: DataFrame) -> DataFrame:
    """``product`` with subtype, customers, rate_note, deposit_note and currency, each by the first rule that holds."""
    c, name = F.col, F.lower("product_name")
    tags = F.coalesce("tags", F.lit(""))
    currency = first_match([(c("country_code") == k, v) for k, v in CURRENCY.items()], "XXX")
    savings = first_match([(~c("country_code").isin("CA", "US") & c("tags").isNull(), "foreign_currency"), (name.rlike("premium|high interest|hisa|gold"), "high_interest"), (tags.contains("student") | tags.contains("youth"), "youth")], "standard")
    chequing = first_match([(F.coalesce("direct_rate", "posted_rate") > 0, "interest_bearing"), (name.rlike("premium|vip|ultimate|signature|all-inclusive|all inclusive"), "premium"), (c("minimum_balance") >= 2500, "package")], "standard")
    gic = first_match([(name.rlike("market.linked|index.linked|equity.linked"), "market_linked"), (c("term_length_days") >= 1000, "non_redeemable"), (c("term_length_days") >= 300, "redeemable")], "other")
    kind = c("product_type")
    subtype = F.when(kind == "savings", savings).when(kind == "chequing", chequing).when(kind == "gic", gic).otherwise("other")
    customers = F.array_compact(F.array(F.when(tags.contains("student") | tags.contains("youth"), "student"), F.when(tags.contains("newcomer"), "newcomer"), F.when(tags.contains("senior"), "senior")))
    note = F.concat(F.concat_ws("; ", F.lit("Stored as percentage points"), F.when(c("term_length_days").isNotNull(), "term-specific rates are listed separately"), F.when((kind == "savings") & c("monthly_fee").isNull(), "interest paid monthly")), F.lit("."))
    deposit = F.when(c("minimum_deposit").isNotNull(), F.concat(F.lit("Minimum deposit in "), currency, F.lit(".")))
    return product.withColumn("currency", currency).withColumn("subtype", subtype).withColumn("customers", customers).withColumn("rate_note", note).withColumn("deposit_note", deposit)
