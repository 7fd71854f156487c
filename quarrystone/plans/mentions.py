"""Evidence that names another product of its bank."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import mentions
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

_GENERIC = "|".join(mentions.GENERIC)


@query(sql(rf"""
WITH t AS (SELECT evidence_id, bank_code, product_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM excerpt WHERE text IS NOT NULL),
whole AS (SELECT bank_code, product_id, array_to_string(regexp_extract_all(lower(product_name), '[a-z0-9]+'), ' ') AS name FROM named),
d AS (SELECT DISTINCT bank_code, product_id, name FROM (SELECT * FROM whole UNION ALL SELECT bank_code, product_id, regexp_replace(name, '( ({_GENERIC}))+$', '') FROM whole) WHERE name <> '' AND NOT regexp_matches(name, '^(({_GENERIC})( |$))+$')),
f AS (SELECT DISTINCT bank_code, name, string_split(name, ' ') AS words FROM d),
m AS (SELECT evidence_id, t.bank_code, product_id, name, s, s + len(words) AS z FROM t JOIN f ON t.bank_code = f.bank_code AND list_has_all(w, words), LATERAL (SELECT unnest(range(1, len(w) - len(words) + 2)) AS s) WHERE w[s:s + len(words) - 1] = words),
k AS (SELECT DISTINCT evidence_id, bank_code, product_id, name FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.evidence_id = a.evidence_id AND b.s <= a.s AND b.z >= a.z AND b.z - b.s > a.z - a.s)),
g AS (SELECT evidence_id, string_agg(CASE WHEN d.product_id IS NULL THEN k.name END, ',' ORDER BY k.name) AS others, max(CAST(d.product_id IS NOT NULL AS INTEGER)) = 1 AS own FROM k LEFT JOIN d USING (bank_code, product_id, name) GROUP BY 1)
SELECT evidence_id, coalesce(others, '') AS others, coalesce(own, false) AS names_own, coalesce(others <> '' AND NOT own, false) AS refused FROM excerpt LEFT JOIN g USING (evidence_id)""", "excerpt", "named"))  # fmt: skip
def other_products(spark, sf_dir):
    """Excerpts that are refused, since they name another product of the bank and not their own."""
    found = mentions.other_products(read(spark, sf_dir, "excerpt"), read(spark, sf_dir, "named"))
    return found.withColumn("others", F.array_join("others", ","))
