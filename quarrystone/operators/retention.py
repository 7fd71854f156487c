"""Retention of operational tables: what is kept spreads along references before anything goes.

Each rule gives the keys that a table keeps. A chunk stays if a field links to it, or if its
document was parsed from a snapshot that stays for another reason: it is its source's newest,
or a run that is at work has selected it. So nothing that is kept points to what is removed.
Keys alone are joined; tables are never gathered.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.picks import latest_per_key

#: Days that results of diagnosis, failed refreshes and served requests stay, hours of login attempts, days of ended sessions, refreshes of each scope.
DIAGNOSED_DAYS, ATTEMPT_HOURS, SESSION_DAYS, REFRESHES = 14, 24, 7, 2
#: The key of each table.
KEYS = {"evidence_chunk": "chunk_id", "model_execution": "execution_id", "aggregate_refresh": "snapshot_id", "refresh_request": "request_id", "login_attempt": "attempt_id", "admin_session": "session_id"}


def _recent(at: Column, now: Column, hours: int) -> Column:
    """Whether ``at`` lies in the last ``hours``; without a time a row isn't old."""
    return F.coalesce(at >= now - F.make_interval(hours=F.lit(hours)), F.lit(True))


def kept_chunks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(chunk_id): linked ones, and all of documents parsed from a source's newest snapshot or from one that a started run has selected."""
    newest = latest_per_key(tables["source_snapshot"], ["source_document_id"], [F.desc("fetched_at"), F.desc("snapshot_id")]).select("snapshot_id")
    at_work = tables["run_source_item"].join(tables["ingestion_run"].where("run_state = 'started'").select("run_id"), "run_id", "left_semi").select(F.col("selected_snapshot_id").alias("snapshot_id"))
    documents = tables["parsed_document"].join(newest.union(at_work).distinct(), "snapshot_id", "left_semi").select("parsed_document_id")
    own = tables["evidence_chunk"].join(documents, "parsed_document_id", "left_semi").select("chunk_id")
    return own.union(tables["field_evidence_link"].select("chunk_id")).distinct()


def kept_executions(tables: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """(execution_id): started or recent ones, those that candidates or started runs refer to, and the last verification of each review."""
    all_ = tables["model_execution"]
    young = all_.where((F.col("execution_status") == "started") | _recent(F.col("started_at"), now, 24 * DIAGNOSED_DAYS)).select("execution_id")
    referred = tables["candidate"].where("execution_id IS NOT NULL").select("execution_id")
    at_work = all_.join(tables["ingestion_run"].where("run_state = 'started'").select("run_id"), "run_id", "left_semi").select("execution_id")
    verified = latest_per_key(all_.where("stage_name = 'ai_verification' AND review_task_id IS NOT NULL"), ["review_task_id"], [F.desc("started_at"), F.desc("execution_id")]).select("execution_id")
    return young.union(referred).union(at_work).union(verified).distinct()


def kept_refreshes(tables: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """(snapshot_id): the last completed ones of each scope and country, failed ones of late, and those that are neither."""
    all_ = tables["aggregate_refresh"]
    done = all_.where("refresh_status = 'completed'")
    last = latest_per_key(done, ["refresh_scope", "country_code"], [F.coalesce("refreshed_at", "attempted_at").desc(), F.desc("attempted_at"), F.desc("snapshot_id")], REFRESHES).select("snapshot_id")
    others = all_.where((F.col("refresh_status") != "completed") & ((F.col("refresh_status") != "failed") | _recent(F.col("attempted_at"), now, 24 * DIAGNOSED_DAYS))).select("snapshot_id")
    return last.union(others)


def keep_sets(tables: Mapping[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The keys that each table keeps, by table."""
    asked, tried, session = tables["refresh_request"], tables["login_attempt"], tables["admin_session"]
    return {
        "evidence_chunk": kept_chunks(tables),
        "model_execution": kept_executions(tables, now),
        "aggregate_refresh": kept_refreshes(tables, now),
        "refresh_request": asked.where(~F.col("request_status").isin("completed", "failed") | _recent(F.coalesce("completed_at", "requested_at"), now, 24 * DIAGNOSED_DAYS)).select("request_id"),
        "login_attempt": tried.where(_recent(F.col("attempted_at"), now, ATTEMPT_HOURS)).select("attempt_id"),
        "admin_session": session.where(_recent(F.coalesce("revoked_at", "absolute_expires_at"), now, 24 * SESSION_DAYS)).select("session_id"),
    }


def retained(tables: Mapping[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """Each table with the rows that stay."""
    return {name: tables[name].join(keys, KEYS[name], "left_semi") for name, keys in keep_sets(tables, now).items()}


def counts(tables: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """(table_name, n, n_kept, n_removed), one row for each table."""
    out = None
    for name, keys in keep_sets(tables, now).items():
        marked = tables[name].select(KEYS[name]).join(keys.distinct().withColumn("kept", F.lit(1)), KEYS[name], "left")
        row = marked.agg(F.count("*").alias("n"), F.count("kept").alias("n_kept")).select(F.lit(name).alias("table_name"), "n", "n_kept", (F.col("n") - F.col("n_kept")).alias("n_removed"))
        out = row if out is None else out.union(row)
    return out


#: Keys of a run's and of a run item's metadata that are needed later than its diagnosis.
RUN_KEYS = (
    "pipeline_stage", "trigger_type", "triggered_by", "country_code", "bank_code", "product_type", "catalog_item_id", "correlation_id", "request_id", "source_ids", "selected_source_ids", "target_source_ids",
    "retry_request_id", "automation_recovered", "automation_recovery_reason",
)


def compacted(runs: DataFrame, metadata: str, now: Column, keys: tuple[str, ...] = RUN_KEYS) -> DataFrame:
    """``runs`` with only ``keys`` left in the JSON metadata of those that ended ``DIAGNOSED_DAYS`` ago; ``compacted`` marks where that took anything."""
    old = F.col("run_state").isin("completed", "failed", "retried") & ~_recent(F.coalesce("completed_at", "started_at"), now, 24 * DIAGNOSED_DAYS)
    given = F.try_parse_json(metadata).try_cast("map<string, variant>")
    own = F.map_filter(given, lambda k, v: k.isin(*keys))
    less = F.coalesce(old & (F.size(own) < F.size(given)), F.lit(False))
    return runs.withColumn("compacted", less).withColumn(metadata, F.when(less, F.to_json(own)).otherwise(F.col(metadata)))
