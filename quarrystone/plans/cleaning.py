r"""Cleaning of candidates: suppressed fields, values in their types, mended descriptions, breaches of contracts, noise in lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import contracts, fieldrules, rates
from quarrystone.operators import cleaning
from quarrystone.plans.rates import FIGURES, _any, _words, expired, left_open, no_annual_rate
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

DAY = "2026-04-13"
_LOWERED = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"
_NUMBER = "TRY_CAST(regexp_replace(trim({}), '[%,$ ]', '', 'g') AS DOUBLE)"
_AMOUNT = r"TRY_CAST(replace(regexp_extract(parts[k], '^ ?([0-9][0-9,]*(\.[0-9][0-9]?)?)', 1), ',', '') AS DOUBLE)"
_TERM_DAYS = r"CAST(floor(TRY_CAST(nullif(regexp_extract(lower({0}), '([0-9]+(?:\.[0-9]+)?)\s*-?\s*(?:day|month|year)', 1), '') AS DOUBLE) * CASE regexp_extract(lower({0}), '[0-9]\s*-?\s*(day|month|year)', 1) WHEN 'day' THEN 1 WHEN 'month' THEN 30 ELSE 365 END + 0.5) AS INTEGER)"
_TERMS = r"regexp_extract_all(lower(term_text), '([0-9]{{1,3}})\s*(day|month|year)s?\b', {})"

SUPPRESSED = rf"""
WITH p AS (SELECT *, {_LOWERED.format('value')} AS v, {_LOWERED.format('context')} AS c, {_LOWERED.format('product_name')} AS name, {_NUMBER.format('value')} AS number FROM candidate_field),
w AS (SELECT *, {_words('c')} AS w, string_split(c, '$') AS parts FROM p), f AS (SELECT *, {FIGURES} AS f FROM w),
g AS (SELECT *, {left_open('v')} AS open_value, {left_open('c')} AS open_evidence, {expired(f"DATE '{DAY}'")} IS NOT NULL AS expired, {no_annual_rate('c')} AS no_annual_rate,
  coalesce(list_contains([CAST(replace(w[i], '%', '') AS DOUBLE) for i in f], number), false) AS stated,
  len([k for k in range(2, len(parts) + 1) if coalesce({_AMOUNT} = number, false) AND {_any("right(parts[k - 1], 90) || '$' || left(parts[k], 100)", fieldrules.SPENDING)}]) > 0 AS spent FROM f),
r AS (SELECT *, {fieldrules.first_reason_sql(fieldrules.SUPPRESSIONS)} AS first, regexp_replace(v, '^[ .:;|_-]+|[ .:;|_-]+$', '', 'g') AS bare FROM g),
s AS (SELECT *, CASE WHEN length(bare) >= {cleaning.COPY} THEN bare ELSE field END AS copy, max(CASE WHEN field = 'term_length_text' AND first IS NULL THEN value END) OVER k AS term_text, max(CASE WHEN field = 'term_rate_table' AND first IS NULL THEN value END) OVER k AS table_text FROM r WINDOW k AS (PARTITION BY candidate_id)),
t AS (SELECT *, count(*) OVER c AS copies, max(CAST(field = 'description_short' AS INTEGER)) OVER c = 1 AS described,
  [CAST({_TERMS.format(1)}[i] AS INTEGER) * CASE {_TERMS.format(2)}[i] WHEN 'day' THEN 1 WHEN 'month' THEN 30 ELSE 365 END for i in range(1, len({_TERMS.format(1)}) + 1)] AS terms,
  CASE WHEN table_text LIKE '[%' THEN len(list_distinct([{_TERM_DAYS.format('x')} for x in json_extract_string(table_text, '$[*].term_label')])) END AS n_terms FROM s WINDOW c AS (PARTITION BY candidate_id, copy)),
done AS (SELECT candidate_id, field, value, coalesce(first, CASE WHEN copies > 1 AND NOT (described AND field = 'description_short') THEN 'copy_in_several_fields'
  WHEN field = 'term_length_days' AND coalesce(len(terms) > 0 AND len([1 for d in terms if abs(CAST(number AS INTEGER) - d) <= greatest(7, round(d * 0.08))]) = 0 AND NOT (len(terms) > 1 AND CAST(number AS INTEGER) BETWEEN list_min(terms) AND list_max(terms)), false) THEN 'days_against_words'
  WHEN field IN ('term_length_days', 'term_length_text') AND coalesce(n_terms >= 2, false) AND coalesce(len(regexp_extract_all(lower(term_text), '([0-9]+) *(day|month|year)', 1)) = 1, false) THEN 'one_term_of_several' END) AS reason FROM t)
"""


def _reasons(spark, sf_dir):
    return cleaning.reasons(read(spark, sf_dir, "candidate_field"), "candidate_id", F.lit(DAY).cast("date"))


@query(sql(SUPPRESSED + "SELECT candidate_id, field, reason FROM done WHERE reason IS NOT NULL", "candidate_field"))
def suppressed_fields(spark, sf_dir):
    """Fields of candidates that a rule empties, and why: the first of some fifty rules on value, evidence, family and name, then those on several fields."""
    return _reasons(spark, sf_dir).where("reason IS NOT NULL").select("candidate_id", "field", "reason")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_TYPE = f"""CASE WHEN field IN {_in(contracts.STRINGS)} THEN 'string' WHEN field IN {_in(contracts.INTEGERS)} THEN 'integer' WHEN field IN {_in(contracts.BOOLEANS)} OR suffix(field, '_flag') THEN 'boolean'
  WHEN field IN {_in(contracts.STRUCTURED)} THEN 'json' WHEN field IN {_in(contracts.DECIMALS)} OR suffix(field, '_rate') OR suffix(field, '_fee') THEN 'decimal' END"""


@query(sql(SUPPRESSED + rf""", k AS (SELECT *, coalesce({_TYPE}, 'string') AS type, nullif(trim(value), '') AS given, CASE WHEN field = 'term_rate_table' AND json_valid(value) THEN value ELSE '[]' END AS rows FROM done WHERE reason IS NULL)
SELECT candidate_id, field, type, CASE WHEN type = 'string' THEN given END AS text,
  CASE WHEN type = 'decimal' THEN CASE WHEN (field IN {_in(contracts.MONEY)} OR suffix(field, '_fee')) AND regexp_matches(lower(given), '^(no|zero|free)( monthly| annual)?( fees?)?$') THEN 0.0 ELSE {_NUMBER.format('lower(given)')} END END AS number,
  CASE WHEN type = 'integer' AND {_NUMBER.format('given')} = floor({_NUMBER.format('given')}) THEN CAST({_NUMBER.format('given')} AS BIGINT) END AS whole, CASE WHEN type = 'boolean' THEN lower(given) = 'true' END AS flag,
  CASE WHEN type = 'json' THEN (SELECT string_agg({_TERM_DAYS.format('x.l')} || ':' || {_NUMBER.format('x.r')}, ',' ORDER BY x.n) FROM (SELECT unnest(json_extract_string(rows, '$[*].term_label')) AS l, unnest(json_extract_string(rows, '$[*].rate')) AS r, generate_subscripts(json_extract_string(rows, '$[*].rate'), 1) AS n) x) END AS rows FROM k""", "candidate_field"))  # fmt: skip
def normalized_fields(spark, sf_dir):
    """Values of the fields that stay, each in the type of its contract."""
    kept = _reasons(spark, sf_dir).where("reason IS NULL")
    value = kept.select("candidate_id", "field", contracts.normalized(F.col("field"), F.col("value")).alias("n")).select("candidate_id", "field", "n.*")
    return value.withColumn("rows", F.array_join(F.transform("rows", lambda r: F.concat(r["days"].cast("string"), F.lit(":"), r["rate"].cast("string"))), ","))


_JOINED = "w"
for _from, _to in cleaning.JOINED.items():
    _JOINED = f"CASE WHEN w = '{_from}' THEN '{_to}' WHEN w = '{_from.capitalize()}' THEN '{_to.capitalize()}' ELSE {_JOINED} END"


@query(sql(rf"""
WITH d AS (SELECT candidate_id, value, string_split(regexp_replace(array_to_string([{_JOINED} for w in string_split(trim(regexp_replace(value, '\s+', ' ', 'g')), ' ')], ' '), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS parts FROM candidate_field WHERE field = 'description_short')
SELECT candidate_id, array_to_string([s for s in parts if NOT (({' OR '.join(f"starts_with(lower(s), '{p}') OR regexp_matches(lower(s), '^(if|when) [^,.]*, {p}')" for p in cleaning.SELLING)}) AND ({' OR '.join(f"contains(lower(s), '{p}')" for p in cleaning.SOLD)}))], ' ') AS description FROM d""", "candidate_field"))  # fmt: skip
def mended_descriptions(spark, sf_dir):
    """Descriptions with joined words apart and without sentences that sell another product."""
    return read(spark, sf_dir, "candidate_field").where("field = 'description_short'").select("candidate_id", cleaning.mended(F.col("value")).alias("description"))


@query(sql(rf"""
WITH j AS (SELECT product_id, TRY_CAST(payload AS JSON) AS p FROM captured), e AS (SELECT product_id, p, unnest(json_keys(p)) AS field FROM j WHERE json_type(p) = 'OBJECT'),
k AS (SELECT product_id, field, {_TYPE} AS value_type, CASE json_type(json_extract(p, '$."' || field || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'NULL' THEN 'null' ELSE 'json' END AS found FROM e)
SELECT product_id, field, value_type, found FROM k WHERE value_type IS NOT NULL AND found <> 'null' AND found <> value_type AND NOT (value_type = 'decimal' AND found = 'integer')""", "captured"))  # fmt: skip
def payload_breaches(spark, sf_dir):
    """Values of captured payloads that aren't of their field's type; each keeps its own type as VARIANT."""
    return cleaning.breaches(read(spark, sf_dir, "captured"), "product_id", "payload")


ASKED = ("interest_rate", "payment_frequency", "amortization_text", "rate_type", "product_name", "application_method", "fees_text")
_ASKED = "[" + ", ".join(f"'{f}'" for f in ASKED) + "]"


@query(rf"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), v AS (SELECT {_LOWERED.format('line')} AS v FROM l WHERE trim(line) <> ''), o AS (SELECT *, {left_open('v')} AS open_value FROM v), n AS (SELECT *, unnest({_ASKED}) AS field FROM o)
SELECT field, {fieldrules.first_reason_sql(fieldrules.NOISE)} AS reason, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY 1, 2""")
def line_noise(spark, sf_dir):
    """How many lines of the documents could not be the value of each of some fields, and why."""
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "").select(fieldrules.lowered(F.col("line")).alias("v"))
    tests = {f"test_{k}": rule.test.spark() for k, rule in enumerate(fieldrules.NOISE)}
    # lines are counted by the tests that they pass, once for all fields; the few counts are then asked for each field
    passed = lines.withColumn("open_value", rates.placeholder(F.col("v"))).groupBy(*[test.alias(name) for name, test in tests.items()]).agg(F.count("*").alias("n"))
    rules = tuple(rule._replace(test=fieldrules.Flag(name)) for name, rule in zip(tests, fieldrules.NOISE, strict=True))
    asked = passed.withColumn("field", F.explode(F.array(*map(F.lit, ASKED))))
    return asked.select("field", fieldrules.first_reason(rules).alias("reason"), "n").groupBy("field", "reason").agg(F.sum("n").alias("n"))
