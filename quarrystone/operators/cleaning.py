"""Cleaning of candidates: one row for each field of a candidate, with the rule that empties it or its value in its type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import contracts, fieldrules, rates
from quarrystone.functions import text as tx
from quarrystone.operators import gates

#: Characters of a text from which on it can be a copy of a page.
COPY = 80


def spent(c: Column, number: Column) -> Column:
    """Whether an amount equal to ``number`` stands among words of deposits, gifts or purchases."""

    def near(parts: Column, k: Column) -> Column:
        before, own = F.get(parts, k - 1), F.get(parts, k)
        amount = F.regexp_replace(F.regexp_extract(own, r"^ ?([0-9][0-9,]*(\.[0-9][0-9]?)?)", 1), ",", "").try_cast("double")
        around = F.concat(F.substring(before, -90, 90), F.lit("$"), F.substring(own, 1, 100))
        return F.coalesce(amount == number, F.lit(False)) & reduce(lambda a, b: a | b, [around.contains(p) for p in fieldrules.SPENDING])

    return rates.let(F.split(c, "[$]"), lambda parts: F.exists(F.slice(F.sequence(F.lit(0), F.size(parts)), 2, F.size(parts) - 1), lambda k: near(parts, k)))


def prepared(fields: DataFrame, day: Column) -> DataFrame:
    """``fields`` (family, product_name, field, value, context) with the columns that the rules ask."""
    df = fields.withColumn("v", fieldrules.lowered(F.col("value"))).withColumn("c", fieldrules.lowered(F.col("context"))).withColumn("name", fieldrules.lowered(F.col("product_name"))).withColumn("number", tx.number(F.col("value")))
    c, number = F.col("c"), F.col("number")
    return (
        df.withColumn("open_value", rates.placeholder(F.col("v")))
        .withColumn("open_evidence", rates.placeholder(c))
        .withColumn("expired", rates.expired_on(c, day).isNotNull())
        .withColumn("no_annual_rate", rates.let(rates.words(c), lambda w: rates.no_annual_rate(c, w)))
        .withColumn("stated", rates.let(rates.words(c), lambda w: F.exists(rates.figures(w), lambda i: F.coalesce(rates.value_at(w, i) == number, F.lit(False)))))
        .withColumn("spent", spent(c, number))
    )


def reasons(fields: DataFrame, key: str, day: Column) -> DataFrame:
    """``fields`` with ``reason``: the first rule that empties the value, by itself or by the candidate's other fields, or null.

    A long text that stands in several fields stays in the description alone; a term in days has
    to fit its words, and one term alone is no term of a table of several.
    """
    df = prepared(fields, day).withColumn("reason", fieldrules.first_reason(fieldrules.SUPPRESSIONS))
    own = Window.partitionBy(key)
    kept = lambda name: F.max(F.when((F.col("field") == name) & F.col("reason").isNull(), F.col("value"))).over(own)
    copy = F.regexp_replace("v", r"^[ .:;|_-]+|[ .:;|_-]+$", "")
    same = Window.partitionBy(key, "copy")
    df = df.withColumn("copy", F.when(F.length(copy) >= COPY, F.sha2(copy, 256)).otherwise(F.col("field"))).withColumn("copies", F.count("*").over(same))
    df = df.withColumn("described", F.max(F.col("field") == "description_short").over(same)).withColumn("term_text", kept("term_length_text")).withColumn("table_text", kept("term_rate_table"))
    rows = contracts.rate_rows(F.col("table_text"))
    several = F.coalesce(F.size(F.array_distinct(F.transform(rows, lambda r: r["days"]))) >= 2, F.lit(False))
    one = F.size(F.regexp_extract_all(F.lower("term_text"), F.lit(r"([0-9]+) *(day|month|year)"), F.lit(1))) == 1
    term, field = F.col("field") == "term_length_days", F.col("field")
    later = (
        F.when((F.col("copies") > 1) & ~(F.col("described") & (field == "description_short")), "copy_in_several_fields")
        .when(term & F.coalesce(gates.term_conflict(F.col("number").cast("int"), F.col("term_text")), F.lit(False)), "days_against_words")
        .when(field.isin("term_length_days", "term_length_text") & several & F.coalesce(one, F.lit(False)), "one_term_of_several")
    )
    return df.withColumn("reason", F.coalesce("reason", later)).select(*fields.columns, "reason")


# Words that markup ran together.
JOINED = {"accountfor": "account for", "iteasier": "it easier", "thechance": "the chance", "growand": "grow and", "youopen": "you open", "aplace": "a place", "atany": "at any", "alittle": "a little"}
SELLING, SOLD = ("try our", "try the", "consider our", "consider the", "explore our", "explore the", "check out our", "check out the"), ("account", "card", "mortgage", "loan", "line of credit")


def mended(x: Column) -> Column:
    """A description with words apart that markup ran together, and without sentences that sell another product."""
    words = F.transform(F.split(tx.collapsed(x), " "), lambda w: reduce(lambda a, p: F.when(w == p[0], p[1]).when(w == p[0].capitalize(), p[1].capitalize()).otherwise(a), JOINED.items(), w))
    marked = F.regexp_replace(F.array_join(words, " "), r"([.!?]) ", "$1\n")
    sells = lambda s: reduce(lambda a, b: a | b, [F.lower(s).startswith(p) | F.lower(s).rlike(f"^(if|when) [^,.]*, {p}") for p in SELLING]) & reduce(lambda a, b: a | b, [F.lower(s).contains(p) for p in SOLD])
    return F.array_join(F.filter(F.split(marked, "\n"), lambda s: ~sells(s)), " ")


def breaches(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, field, value_type, found): fields of JSON payloads whose values aren't of their field's type.

    Payloads are read as VARIANT, so each value keeps its own type; what isn't JSON, or no object, has no fields.
    The parser passes over what follows an object, so that is asked for separately.
    """
    whole = F.when(F.trim(payload).endswith("}"), F.col(payload))
    read = payloads.select(F.col(key), F.try_parse_json(whole).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    each = read.select(key, F.inline(F.map_entries(F.col("v").try_cast("map<string, variant>")))).withColumnsRenamed({"key": "field"})
    kind = contracts.value_type(F.col("field"))
    return each.withColumn("value_type", kind).withColumn("found", contracts.kind_of_variant(F.col("value"))).where(~contracts.fits(F.col("value_type"), F.col("found"))).select(key, "field", "value_type", "found")
