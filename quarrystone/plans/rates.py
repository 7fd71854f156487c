"""Rates in the offers' prose: what is suppressed, what an offer promises, what a card shows, tables of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import rates
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

T = r"lower(trim(regexp_replace(coalesce(offer_text, ''), '\s+', ' ', 'g')))"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def _words(x: str) -> str:
    """The words of a text, in DuckDB's SQL."""
    for pattern, to in rates.STEPS:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return f"string_split_regex(trim({x}), ' +')"


def _any(x: str, phrases) -> str:
    return f"len([1 for phrase in {_list(phrases)} if contains({x}, phrase)]) > 0"


def left_open(x: str) -> str:
    """Whether a text leaves a figure open, in DuckDB's SQL."""
    return f"({_any(x, rates.LEFT_OPEN)} OR len([1 for word in {_words(x)} if regexp_matches(translate(word, '$.%', ''), '^[x*]{{2,}}$')]) > 0)"


def _beside(rule: rates.Beside) -> str:
    tests = [f"list_has_any(w[greatest(i - {n}, 1):i - 1], {_list(g)})" for g, n in rule.before] + [f"list_has_any(w[i + 1:i + {n}], {_list(g)})" for g, n in rule.after]
    if rule.never[1]:
        tests.append(f"NOT list_has_any(w[greatest(i - {rule.never[1]}, 1):i - 1], {_list(rule.never[0])})")
    return "(" + " AND ".join(tests) + ")"


_DAY_AFTER = rf"""CAST(coalesce(CASE WHEN regexp_matches(array_to_string(w[i + 1:i + 5], ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_strptime(array_to_string(w[i + 1:i + 5], ''), '%Y-%m-%d') END,
  CASE WHEN list_contains({_list(rates.MONTH_WORDS)}, w[i + 1]) AND regexp_matches(w[i + 3], '^[0-9]{{4}}$') THEN try_strptime(substr(w[i + 1], 1, 3) || ' ' || regexp_replace(w[i + 2], '(st|nd|rd|th)$', '') || ' ' || w[i + 3], '%b %d %Y') END) AS DATE)"""
_VALUE = "CAST(replace(w[i], '%', '') AS DOUBLE)"
_TOTAL = ", ".join(f"[v for v in [{_VALUE} for i in f if {_beside(r)}] if v < {rates.IMPLAUSIBLE}][1]" for r in rates.TOTALS)


#: Whether a text with words w and figures f ended before a day, and whether it tells of no annual rate.
def expired(day: str) -> str:
    return f"[d for d in [{_DAY_AFTER} for i in range(1, len(w) + 1) if list_contains({_list(rates.ENDING)}, w[i])] if d < {day}][1]"


def no_annual_rate(x: str) -> str:
    return f"({_any(x, rates.NOT_ANNUAL)} OR len([1 for i in f if {' OR '.join(map(_beside, rates.NO_RATES))}]) > 0)"


FIGURES = f"[i for i in range(1, len(w) + 1) if regexp_matches(w[i], {quoted(rates.FIGURE)})]"


@query(sql(rf"""
WITH o AS (SELECT product_id, display_rate, reference_date, {T} AS t FROM offer), w AS (SELECT *, {_words('t')} AS w FROM o), f AS (SELECT *, [i for i in range(1, len(w) + 1) if regexp_matches(w[i], {quoted(rates.FIGURE)})] AS f FROM w),
e AS (SELECT *, {expired('reference_date')} AS expired, {no_annual_rate('t')} AS no_rate,
  {left_open('t')} AS left_open, len([1 for i in f if list_has_any(w[greatest(i - 4, 1):i - 1], {_list(rates.LABELS)}) OR list_has_any(w[i + 1:i + 2], {_list(rates.LABELS)})]) > 0 AS labelled FROM f)
SELECT product_id, CASE WHEN expired IS NOT NULL THEN 'expired_promotional_offer' WHEN no_rate THEN 'non_annual_return_context' WHEN display_rate >= {rates.IMPLAUSIBLE} THEN 'implausible_annual_deposit_rate' END AS reason, expired AS expired_on,
  CASE WHEN {_any('t', rates.PROMO_MARKS)} AND NOT no_rate AND expired IS NULL THEN coalesce({_TOTAL}) END AS promotional_total, left_open, NOT left_open AND labelled AS explicit FROM e""", "offer"))  # fmt: skip
def rate_suppressions(spark, sf_dir):
    """Why the rate of an offer isn't shown, when the offer ended, what it promises in all, and whether it states a rate at all."""
    t, day = F.col("t"), F.col("reference_date")
    df = read(spark, sf_dir, "offer").withColumn("t", rates.context(F.col("offer_text")))
    return df.select("product_id", rates.suppression(F.col("display_rate"), t, day).alias("reason"), rates.expired_on(t, day).alias("expired_on"), rates.promotional_total(t, day).alias("promotional_total"), rates.placeholder(t).alias("left_open"), rates.explicit(t).alias("explicit"))


def _spoken(first: str, last: str, phrases) -> str:
    return _any(f"' ' || array_to_string(w[greatest({first}, 1):{last}], ' ') || ' '", [f" {p} " for p in phrases])


def _fits(i: str, j: str) -> str:
    spread = f"list_has_any(w[greatest({i} - 4, 1):{i} - 1], {_list(rates.BASES)}) AND list_has_any(w[greatest({i} - 2, 1):{i} - 1], {_list(rates.ADDED)})"
    return f"{_spoken(f'{i} - {rates.REACH}', f'{j} + {rates.REACH}', rates.NEAR)} AND NOT ({_spoken(f'{i} - {rates.CLOSE}', f'{j} + {rates.CLOSE}', rates.AGAINST)}) AND NOT ({spread})"


MINED = rf"""
WITH o AS (SELECT *, lower(trim(regexp_replace(regexp_replace(coalesce(offer_text, ''), '\*\*|__', '', 'g'), '\s+', ' ', 'g'))) AS t FROM offer), w AS (SELECT *, {_words('t')} AS w FROM o), f AS (SELECT *, [i for i in range(1, len(w) + 1) if regexp_matches(w[i], {quoted(rates.FIGURE)})] AS f FROM w),
g AS (SELECT *, [{_VALUE} for i in f if {_spoken('i + 1', 'i + 2', rates.INTRO)} OR {_spoken('i - 4', 'i - 1', rates.INTRO)}] AS intro, [{_VALUE} for i in f if {_fits('i', 'i')}] AS single,
  [p for p in [{{'i': f[k], 'j': f[k + 1]}} for k in range(1, len(f))] if len([1 for x in w[p.i + 1:p.j - 1] if NOT list_contains({_list(rates.BETWEEN)}, x)]) = 0 AND list_has_any(w[p.i + 1:p.j - 1], {_list(rates.TO)}) AND {_fits('p.i', 'p.j')}] AS pairs FROM f),
m AS (SELECT *, CASE WHEN regexp_extract(t, '^\s*([0-9]{{1,3}}(?:\.[0-9]+)?)\s*%?\s*$', 1) <> '' THEN [CAST(regexp_extract(t, '^\s*([0-9]{{1,3}}(?:\.[0-9]+)?)\s*%?\s*$', 1) AS DOUBLE)] WHEN len(pairs) > 0 THEN list_concat(intro, [{_VALUE} for i in [pairs[1].i, pairs[1].j]]) ELSE list_concat(intro, single) END AS mined FROM g),
l AS (SELECT *, list_min([r for r in mined if r BETWEEN 0 AND 100]) AS low, CASE WHEN display_rate BETWEEN 0 AND 100 THEN display_rate END AS own FROM m)
"""


@query(sql(MINED + "SELECT product_id, array_to_string([CAST(r AS DECIMAL(9, 2)) for r in mined], ',') AS mined, CASE WHEN product_family <> 'lending' THEN display_rate WHEN product_type = 'credit-card' THEN coalesce(low, own) ELSE least(low, own) END AS card_rate FROM l", "offer"))
def mined_rates(spark, sf_dir):
    """The rates that an offer's prose gives a product, and the one that its card shows."""
    found = rates.mined(F.col("offer_text"))
    card = rates.card_rate(F.col("product_type"), F.col("product_family"), F.col("display_rate"), F.col("offer_text"))
    return read(spark, sf_dir, "offer").select("product_id", F.array_join(F.transform(found, lambda r: r.cast("decimal(9,2)").cast("string")), ",").alias("mined"), card.alias("card_rate"))


def _rows(pattern: str, a: int, u: int, r: int) -> str:
    every = lambda g: f"regexp_extract_all(t, {quoted(pattern)}, {g})"
    each = f"[{{'days': CAST(floor(CAST({every(a)}[i] AS DOUBLE) * CASE {every(u)}[i] WHEN 'day' THEN 1 WHEN 'month' THEN 30 ELSE 365 END + 0.5) AS INTEGER), 'rate': CAST({every(r)}[i] AS DOUBLE)}} for i in range(1, len({every(a)}) + 1)]"
    return f"[x for x in {each} if x.rate < {rates.IMPLAUSIBLE}]"


@query(sql(rf"""
WITH o AS (SELECT product_id, {T} AS t FROM offer), w AS (SELECT *, {_rows(rates.AHEAD, 1, 2, 3)} AS ahead, {_rows(rates.BEHIND, 2, 3, 1)} AS behind, {_rows(rates.YIELDS, 1, 2, 4)} AS yields,
  regexp_matches(t, {quoted(rates.RATE)}) AND regexp_matches(t, {quoted(rates.TERM)}) AND length(regexp_extract(t, {quoted('^(.*?)' + rates.RATE)}, 1)) < length(regexp_extract(t, {quoted('^(.*?)' + rates.TERM)}, 1)) AS rate_first FROM o),
c AS (SELECT product_id, CASE WHEN regexp_matches(regexp_extract(t, {quoted('^(.*?)' + rates.TERM)}, 1), {quoted(rates.YIELD_HEAD)}) AND len(list_distinct(yields)) >= 2 THEN yields
  WHEN len(list_distinct(behind)) > len(list_distinct(ahead)) OR len(list_distinct(behind)) = len(list_distinct(ahead)) AND rate_first THEN behind ELSE ahead END AS rows FROM w)
SELECT product_id, CAST(len(list_distinct(rows)) AS INTEGER) AS n_rows, list_max([x.rate for x in rows]) AS best_rate, rows[1].days AS first_days, list_min([x.days for x in rows]) AS shortest FROM c""", "offer"))  # fmt: skip
def text_rate_tables(spark, sf_dir):
    """Tables of terms and rates that offers spell out."""
    rows = F.col("rows")
    return read(spark, sf_dir, "offer").select("product_id", rates.rate_table(F.col("offer_text")).alias("rows")).select(
        "product_id", F.size(rows).alias("n_rows"), F.array_max(F.transform(rows, lambda r: r["rate"])).alias("best_rate"), F.expr("try_element_at(rows, 1).days").alias("first_days"), F.array_min(F.transform(rows, lambda r: r["days"])).alias("shortest")
    )
