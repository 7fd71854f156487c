"""Validation: issue codes, status, confidence and routing, each from ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue_codes(rules: list[tuple[str, Column]]) -> Column:
    """Codes of the rules that hold, in order of code, each once."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(test, code) for code, test in rules]))))


def severity(codes: Column, errors: list[str]) -> Column:
    """error where a code is one of ``errors``, warning where there is any, else pass."""
    return F.when(F.arrays_overlap(codes, F.array(*map(F.lit, errors))), "error").when(F.size(codes) > 0, "warning").otherwise("pass")


def weighted(parts: list[tuple[float, Column]], penalties: list[tuple[float, Column]]) -> Column:
    """A score from weighted parts less penalties, between 0 and 0.99, to four places."""
    score = sum((F.lit(w) * F.coalesce(v, F.lit(0.0)) for w, v in parts), F.lit(0.0))
    for amount, test in penalties:
        score = score - F.when(test, amount).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 4)


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out if otherwise is None else out.otherwise(otherwise)


def conflicts(values: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Fields of a key with more than one distinct value."""
    return values.where(F.col(value).isNotNull()).groupBy(key, field).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def contract_breaches(df: DataFrame, key: str, contract: dict[str, str]) -> DataFrame:
    """(key, field, value) of texts that don't cast to the type that their field's contract names."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (F.col(f).isNotNull() & F.col(f).cast("string").try_cast(kind).isNull()).alias("bad")) for f, kind in contract.items()])
    return df.select(key, F.inline(pairs)).where("bad").drop("bad")
