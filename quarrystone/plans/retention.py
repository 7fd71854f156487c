r"""Retention of operational tables, with counts by table, and metadata of runs that is taken back to what is needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import retention
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

#: The day that orders, and the one that events, are looked back from.
NOW, EVENTS_NOW = "2001-08-01 00:00:00", "2024-01-28 00:00:00"
TABLES = ("source_snapshot", "parsed_document", "evidence_chunk", "field_evidence_link", "ingestion_run", "run_source_item", "model_execution", "candidate", "refresh_request", "login_attempt", "admin_session")


def tables(spark, sf_dir):
    own = {name: read(spark, sf_dir, name) for name in TABLES}
    # refreshes are of the orders' years: they are brought to those of the events, so that one day serves all
    return own | {"aggregate_refresh": read(spark, sf_dir, "refresh").withColumn("attempted_at", F.col("attempted_at") + F.expr("INTERVAL 8215 DAYS")).withColumn("refreshed_at", F.col("refreshed_at") + F.expr("INTERVAL 8215 DAYS"))}


@query(sql(f"""
WITH newest AS (SELECT snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY fetched_at DESC, snapshot_id DESC) AS k FROM source_snapshot) WHERE k = 1),
busy AS (SELECT run_id FROM ingestion_run WHERE run_state = 'started'), docs AS (SELECT parsed_document_id FROM parsed_document WHERE snapshot_id IN (SELECT snapshot_id FROM newest UNION SELECT selected_snapshot_id FROM run_source_item WHERE run_id IN (SELECT run_id FROM busy))),
chunks AS (SELECT chunk_id IN (SELECT chunk_id FROM field_evidence_link) OR parsed_document_id IN (SELECT parsed_document_id FROM docs) AS kept FROM evidence_chunk),
verified AS (SELECT execution_id FROM (SELECT *, row_number() OVER (PARTITION BY review_task_id ORDER BY started_at DESC, execution_id DESC) AS k FROM model_execution WHERE stage_name = 'ai_verification' AND review_task_id IS NOT NULL) WHERE k = 1),
executions AS (SELECT execution_status = 'started' OR started_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY OR execution_id IN (SELECT execution_id FROM candidate WHERE execution_id IS NOT NULL) OR run_id IN (SELECT run_id FROM busy) OR execution_id IN (SELECT execution_id FROM verified) AS kept FROM model_execution),
refreshes AS (SELECT CASE refresh_status WHEN 'completed' THEN row_number() OVER (PARTITION BY refresh_scope, country_code, refresh_status ORDER BY coalesce(refreshed_at, attempted_at) DESC, attempted_at DESC, snapshot_id DESC) <= 2 WHEN 'failed' THEN attempted_at + INTERVAL 8215 DAY >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY ELSE true END AS kept FROM refresh),
requests AS (SELECT request_status NOT IN ('completed', 'failed') OR coalesce(completed_at, requested_at) >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY AS kept FROM refresh_request),
attempts AS (SELECT attempted_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR AS kept FROM login_attempt), sessions AS (SELECT coalesce(revoked_at, absolute_expires_at) >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AS kept FROM admin_session),
every AS ({' UNION ALL '.join(f"SELECT '{name}' AS table_name, kept FROM {view}" for name, view in (('evidence_chunk', 'chunks'), ('model_execution', 'executions'), ('aggregate_refresh', 'refreshes'), ('refresh_request', 'requests'), ('login_attempt', 'attempts'), ('admin_session', 'sessions')))})
SELECT table_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS n_kept, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_removed FROM every GROUP BY 1""", *TABLES, "refresh"))  # fmt: skip
def retention_counts(spark, sf_dir):
    """How many rows each operational table keeps and loses."""
    return retention.counts(tables(spark, sf_dir), F.lit(EVENTS_NOW).cast("timestamp"))


@query(sql(f"""
WITH r AS (SELECT *, run_state IN ('completed', 'failed', 'retried') AND coalesce(completed_at, started_at) < TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND contains(run_metadata, '"notes"') AS compacted FROM ingestion_run)
SELECT run_id, compacted, CASE WHEN compacted THEN '{{"bank_code":"' || json_extract_string(run_metadata, '$.bank_code') || '","pipeline_stage":"parse"}}' ELSE run_metadata END AS run_metadata FROM r""", "ingestion_run"))  # fmt: skip
def compacted_runs(spark, sf_dir):
    """Metadata of runs that ended a while ago, with the keys that are still needed."""
    return retention.compacted(read(spark, sf_dir, "ingestion_run"), "run_metadata", F.lit(NOW).cast("timestamp")).select("run_id", "compacted", "run_metadata")
