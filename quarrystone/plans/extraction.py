"""Fields of candidates, read from the chunks of their pages."""

from __future__ import annotations

from quarrystone.functions import parsers
from quarrystone.functions.fieldrules import quoted
from quarrystone.operators import extraction
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query(sql(rf"""
WITH c AS (SELECT candidate_id, family, chunk_id, chunk_index, string_split(regexp_replace(text, {quoted(parsers.ENDS)}, chr(1), 'g'), chr(1)) AS parts FROM page_chunk WHERE chunk_id NOT LIKE '%7-0'),
s AS (SELECT candidate_id, family, chunk_id, chunk_index, k AS pos, parts[k] AS o, lower(parts[k]) AS s FROM c, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS k) WHERE trim(parts[k]) <> ''),
f AS (SELECT candidate_id, chunk_id, chunk_index, pos, trim(o) AS quote, unnest({parsers.found_sql()}) AS x FROM s),
r AS (SELECT candidate_id, x.field AS field, x.value AS value, x.step AS step, chunk_id, quote, row_number() OVER (PARTITION BY candidate_id, x.field ORDER BY x.step, chunk_index, pos) AS k FROM f)
SELECT candidate_id, field, value, CAST(step AS INTEGER) AS step, chunk_id, quote FROM r WHERE k = 1""", "page_chunk"))  # fmt: skip
def extracted_fields(spark, sf_dir):
    """What the pages of candidates say of their fields, with the sentence that says it; chunks that were refused say nothing."""
    chunks = read(spark, sf_dir, "page_chunk")
    return extraction.extract(chunks, "candidate_id", chunks.where("chunk_id LIKE '%7-0'"))
