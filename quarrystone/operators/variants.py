"""Pages that hold several products: their parts of like structure become candidates, each grounded in its own part.

A part is a section under its heading. A field is the first line of the part that has its
label and a value; so the quote of each value stands in its own part, and a part without all
fields of its type is no product. Two products or more make a page one of variants.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY, PERCENT, ANY = r"\$ ?([0-9][0-9,]*(?:\.[0-9]{1,2})?)", r"([0-9]{1,3}(?:\.[0-9]+)?) ?%", "(.*[^ ].*)"


class Wanted(NamedTuple):
    """A field of a type: words of which one labels its line, and what of the line is the value."""

    name: str
    labels: tuple[str, ...]
    value: str


# What a part has to show of each type that pages list side by side.
TYPES = {
    "credit-card": (Wanted("annual_fee", ("annual fee",), MONEY), Wanted("purchase_interest_rate", ("purchase rate", "purchase interest", "purchases", "purchase apr"), PERCENT)),
    "line-of-credit": (
        Wanted("interest_rate_summary", ("rate", "prime"), ANY), Wanted("credit_limit_text", ("limit",), ANY), Wanted("minimum_payment_text", ("minimum payment", "interest only", "interest-only"), ANY),
        Wanted("security_requirement", ("secured", "unsecured", "equity", "collateral"), ANY),
    ),
}
#: Headings that name no product.
NO_NAMES = ("document", "overview", "compare", "details", "frequently asked questions", "legal")


def _line(lines: Column, field: Wanted) -> Column:
    return F.get(F.filter(lines, lambda s: F.lower(s).rlike("|".join(field.labels)) & s.rlike(field.value)), F.lit(0))


def variants(parts: DataFrame, types: DataFrame, least: int = 2) -> DataFrame:
    """(page_id, candidate_key, product_type, product_name, fields, quotes, section_index, n_variants) of pages with ``least`` valid parts.

    ``parts`` are (page_id, section_index, text) with the heading as first line; ``types`` is
    (page_id, product_type). Of parts that share a name the first counts. Pages of other types
    and pages with fewer valid parts make no rows: they stay one candidate.
    """
    lines = F.split("text", "\n")
    df = parts.join(types, "page_id").select("page_id", "section_index", "product_type", F.get(lines, F.lit(0)).alias("product_name"), F.slice(lines, 2, F.size(lines)).alias("lines"))
    fields = quotes = complete = None
    for kind, wanted in TYPES.items():
        found = [(w.name, _line(F.col("lines"), w), w.value) for w in wanted]
        values = F.create_map(*[x for name, line, value in found for x in (F.lit(name), F.regexp_extract(line, value, 1))])
        lines_ = F.create_map(*[x for name, line, _ in found for x in (F.lit(name), line)])
        whole = F.lit(True)
        for _, line, _ in found:
            whole = whole & line.isNotNull()
        here = F.col("product_type") == kind
        fields, quotes, complete = (F.when(here, new) if old is None else old.when(here, new) for old, new in ((fields, values), (quotes, lines_), (complete, whole)))
    name = F.lower(F.trim("product_name"))
    valid = df.withColumn("fields", fields).withColumn("quotes", quotes).where(F.coalesce(complete, F.lit(False)) & (F.length(name) >= 3) & ~name.isin(*NO_NAMES)).withColumn("name", name)
    first = valid.groupBy("page_id", "name").agg(F.min_by(F.struct("product_type", "product_name", "fields", "quotes", "section_index"), "section_index").alias("v"))
    counts = first.groupBy("page_id").agg(F.count("*").alias("n_variants")).where(F.col("n_variants") >= least)
    key = F.concat(F.lit("grounded-"), F.col("v.product_type"), F.lit("-"), F.substring(F.sha2(F.col("name"), 256), 1, 16))
    return first.join(counts, "page_id").select("page_id", key.alias("candidate_key"), "v.*", "n_variants")
