r"""Comparison requirements by market, held against what candidates have."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import rates
from quarrystone.operators import profiles
from quarrystone.plans.rates import FIGURES, _list, _words, left_open, quoted
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

_RULES = ", ".join(f"('{c}', '{t}', {n}, {_list(fields)}, {when is not None})" for (c, t), own in profiles.PROFILES.items() for n, (_, fields, when) in enumerate(own))
_IS_RATE = "(suffix({0}, '_rate') OR {0} = 'rate')"


@query(sql(rf"""
WITH rules AS (SELECT * FROM (VALUES {_RULES}) x(country, type, n, fields, with_fee)), c AS (SELECT product_id, upper(trim(coalesce(country_code, ''))) AS country, lower(trim(coalesce(product_type, ''))) AS type, CAST(payload AS JSON) AS p, string_split(expected, ',') AS expected FROM profiled),
e AS (SELECT product_id, unnest(json_keys(p)) AS field, p FROM c), v AS (SELECT product_id, field, json_type(p, '$.' || field) AS kind, json_extract_string(p, '$.' || field) AS s FROM e), w AS (SELECT *, {_words("lower(coalesce(s, ''))")} AS w FROM v), f AS (SELECT *, {FIGURES} AS f FROM w),
u AS (SELECT product_id, field, coalesce(kind <> 'NULL' AND trim(s) NOT IN ('', '[]'), false) AS there, CASE WHEN field = 'term_rate_table' THEN coalesce(kind = 'ARRAY' AND contains(s, '"rate"') AND contains(s, '"term_label"'), false) WHEN field = 'unlimited_transactions_flag' THEN kind = 'BOOLEAN' AND s = 'true' WHEN field IN ('redeemable_flag', 'non_redeemable_flag') THEN kind = 'BOOLEAN'
  WHEN suffix(field, 'rate_summary') THEN NOT {left_open("lower(s)")} AND len([1 for i in f if list_has_any(w[greatest(i - 4, 1):i - 1], {_list(rates.LABELS)}) OR list_has_any(w[i + 1:i + 2], {_list(rates.LABELS)})]) > 0
  WHEN {_IS_RATE.format('field')} OR field = 'annual_fee' THEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR kind = 'VARCHAR' AND regexp_matches(s, {quoted(profiles.NUMBER)}) ELSE true END AS fits FROM f),
fee AS (SELECT product_id, max(TRY_CAST(regexp_replace(trim(s), '[%,$ ]', '', 'g') AS DOUBLE)) AS fee FROM v WHERE field = 'monthly_fee' AND kind <> 'NULL' GROUP BY 1),
m AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE r.country = c.country AND r.type = c.type) THEN c.country WHEN c.country IN ('', 'CA') AND EXISTS (SELECT 1 FROM rules r WHERE r.country = '*' AND r.type = c.type) THEN '*' END AS profile, EXISTS (SELECT 1 FROM rules r WHERE r.country = '*' AND r.type = c.type) AS known FROM c),
asked AS (SELECT product_id, m.type, n, fields FROM m JOIN rules r ON r.country = m.profile AND r.type = m.type LEFT JOIN fee USING (product_id) WHERE NOT with_fee OR coalesce(fee > 0, false)
  UNION ALL SELECT product_id, type, k, [CASE k WHEN 0 THEN 'standard_rate' ELSE 'monthly_fee' END] FROM m, (SELECT unnest([0, 1]) AS k) WHERE profile IS NULL AND type <> '' AND (NOT known OR country = '') AND list_contains(expected, 'monthly_fee')),
a AS (SELECT product_id, type, n, fields[1] AS wanted, unnest(fields) AS field, generate_subscripts(fields, 1) AS k FROM asked),
s AS (SELECT a.product_id, a.type, n, wanted, arg_min(a.field, k) FILTER (WHERE there AND fits) AS field FROM a LEFT JOIN u ON u.product_id = a.product_id AND u.field = a.field GROUP BY 1, 2, 3, 4),
x AS (SELECT s.* EXCLUDE field, CASE WHEN type = 'savings' AND wanted = 'standard_rate' AND field = 'public_display_rate' AND EXISTS (SELECT 1 FROM u WHERE u.product_id = s.product_id AND u.field = 'promotional_rate' AND there) THEN NULL ELSE field END AS field FROM s),
g AS (SELECT product_id, string_agg(field, ',' ORDER BY n) AS satisfied, string_agg(CASE WHEN field IS NULL THEN wanted END, ',' ORDER BY n) AS missing FROM x GROUP BY 1)
SELECT product_id, profile, type <> '' AS applicable, type = '' OR g.product_id IS NOT NULL AS contract_defined, type = '' OR coalesce(g.product_id IS NOT NULL AND missing IS NULL, false) AS complete, coalesce(satisfied, '') AS satisfied, coalesce(missing, '') AS missing FROM m LEFT JOIN g USING (product_id)""", "profiled"))  # fmt: skip
def comparison_profiles(spark, sf_dir):
    """Whether candidates have what comparisons in their market ask, by the rules of their country, the baseline, or none."""
    found = profiles.quality(read(spark, sf_dir, "profiled").withColumn("expected", F.split("expected", ",")), "payload", "expected")
    return found.select("product_id", "profile", "applicable", "contract_defined", "complete", F.array_join("satisfied", ",").alias("satisfied"), F.array_join("missing", ",").alias("missing"))
