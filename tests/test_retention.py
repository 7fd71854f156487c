"""Keep-sets of operational tables: what stays, and that nothing kept points to what goes."""

import datetime

from pyspark.sql import functions as F

from quarrystone.operators import retention
from quarrystone.plans import retention as plans

NOW = datetime.datetime(2026, 4, 13)
SF = "/root/testdata/sf0.001"


def days(n):
    return NOW - datetime.timedelta(days=n)


def tables(spark, **given):
    schemas = {
        "source_snapshot": "snapshot_id string, source_document_id string, fetched_at timestamp", "parsed_document": "parsed_document_id string, snapshot_id string", "evidence_chunk": "chunk_id string, parsed_document_id string",
        "field_evidence_link": "chunk_id string, field_id string", "ingestion_run": "run_id string, run_state string", "run_source_item": "run_id string, selected_snapshot_id string",
        "model_execution": "execution_id string, run_id string, execution_status string, stage_name string, review_task_id string, started_at timestamp", "candidate": "candidate_id string, execution_id string",
        "aggregate_refresh": "snapshot_id string, refresh_scope string, country_code string, refresh_status string, attempted_at timestamp, refreshed_at timestamp",
        "refresh_request": "request_id string, request_status string, requested_at timestamp, completed_at timestamp", "login_attempt": "attempt_id string, attempted_at timestamp", "admin_session": "session_id string, revoked_at timestamp, absolute_expires_at timestamp",
    }
    return {name: spark.createDataFrame(given.get(name, []), schema) for name, schema in schemas.items()}


def kept(own, name):
    return {r[0] for r in retention.retained(own, F.lit(NOW))[name].collect()}


def test_chunks_stay_by_link_newest_snapshot_or_run_at_work(spark):
    own = tables(
        spark,
        source_snapshot=[("n1", "d1", days(9)), ("n2", "d1", days(1)), ("n3", "d2", days(5)), ("n4", "d1", days(4)), ("n5", "d1", days(1))], parsed_document=[(f"p{k}", f"n{k}") for k in range(1, 6)],
        evidence_chunk=[(f"c{k}", f"p{k}") for k in range(1, 6)] + [("c6", "p1"), ("c7", None)], field_evidence_link=[("c6", "f"), ("c6", "g")], ingestion_run=[("r1", "started"), ("r2", "completed")], run_source_item=[("r1", "n4"), ("r2", "n1")],
    )
    # c5: the newest of d1 (of equal times the greater id); c3: of d2; c4: a started run; c6: linked
    assert kept(own, "evidence_chunk") == {"c3", "c4", "c5", "c6"}


def test_executions(spark):
    old = days(15)
    own = tables(
        spark,
        model_execution=[
            ("young", "r", "completed", "x", None, days(13)), ("old", "r", "completed", "x", None, old), ("working", "r", "started", "x", None, old), ("referred", "r", "failed", "x", None, old), ("of a run", "r1", "completed", "x", None, old),
            ("last", "r", "completed", "ai_verification", "t", old), ("before", "r", "completed", "ai_verification", "t", days(16)), ("no task", "r", "completed", "ai_verification", None, old), ("no time", "r", "completed", "x", None, None),
        ],
        candidate=[("n", "referred"), ("m", None)], ingestion_run=[("r1", "started"), ("r", "failed")],
    )
    assert kept(own, "model_execution") == {"young", "working", "referred", "of a run", "last", "no time"}


def test_refreshes_requests_attempts_and_sessions(spark):
    own = tables(
        spark,
        aggregate_refresh=[(f"s{k}", "public", "CA", "completed", days(k), days(k)) for k in range(1, 5)] + [("u", "public", "US", "completed", days(99), None), ("f1", "public", "CA", "failed", days(3), None), ("f2", "public", "CA", "failed", days(15), None), ("w", "public", "CA", "started", days(40), None)],
        refresh_request=[("a", "waiting", days(30), None), ("b", "completed", days(30), days(13)), ("c", "completed", days(30), days(15)), ("d", "failed", days(13), None), ("e", "failed", days(15), None)],
        login_attempt=[("x", days(0.5)), ("y", days(2)), ("z", None)], admin_session=[("a", days(8), days(1)), ("b", None, days(6)), ("c", None, days(8)), ("d", days(2), days(30))],
    )
    assert kept(own, "aggregate_refresh") == {"s1", "s2", "u", "f1", "w"}
    assert kept(own, "refresh_request") == {"a", "b", "d"} and kept(own, "login_attempt") == {"x", "z"} and kept(own, "admin_session") == {"b", "d"}
    got = {r.table_name: (r.n, r.n_kept, r.n_removed) for r in retention.counts(own, F.lit(NOW)).collect()}
    assert got["aggregate_refresh"] == (8, 5, 3) and got["evidence_chunk"] == (0, 0, 0) and len(got) == 6


def test_nothing_kept_points_to_what_is_removed(spark):
    own = plans.tables(spark, SF)
    now = F.lit(plans.EVENTS_NOW).cast("timestamp")
    stay = retention.retained(own, now)
    assert own["field_evidence_link"].join(stay["evidence_chunk"], "chunk_id", "left_anti").join(own["evidence_chunk"], "chunk_id", "left_semi").count() == 0
    assert own["candidate"].where("execution_id IS NOT NULL").join(own["model_execution"], "execution_id", "left_semi").join(stay["model_execution"], "execution_id", "left_anti").count() == 0
    assert 0 < stay["evidence_chunk"].count() < own["evidence_chunk"].count() and 0 < stay["model_execution"].count() < own["model_execution"].count()
    # a second run over what stayed removes nothing
    again = own | stay
    assert all(r.n_removed == 0 for r in retention.counts(again, now).collect())


def test_metadata_of_ended_runs(spark):
    rows = [("a", "completed", days(15), '{"bank_code": "B", "notes": [1]}'), ("b", "completed", days(15), '{"bank_code": "B"}'), ("c", "started", days(15), '{"notes": 1}'), ("d", "failed", days(13), '{"notes": 1}'), ("e", "failed", days(15), '{"notes": 1}'), ("f", "failed", days(15), None), ("g", "failed", days(15), "no json")]
    df = spark.createDataFrame([(i, s, t, None, m) for i, s, t, m in rows], "run_id string, run_state string, started_at timestamp, completed_at timestamp, meta string")
    got = {r.run_id: (r.compacted, r.meta) for r in retention.compacted(df, "meta", F.lit(NOW)).collect()}
    assert got == {"a": (True, '{"bank_code":"B"}'), "b": (False, '{"bank_code": "B"}'), "c": (False, '{"notes": 1}'), "d": (False, '{"notes": 1}'), "e": (True, "{}"), "f": (False, None), "g": (False, "no json")}
