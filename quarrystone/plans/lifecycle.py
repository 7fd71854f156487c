"""Versions, upserts, superseding, retention and schedules over the adapter relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import picks, state
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

AS_OF = "2001-06-01 00:00:00"


@query(sql("SELECT product_id, version_id, version_no, approved_at AS valid_from, lead(approved_at) OVER w AS valid_to, CASE WHEN lead(version_no) OVER w IS NULL THEN 'approved' ELSE 'superseded' END AS version_status FROM version WINDOW w AS (PARTITION BY product_id ORDER BY version_no)", "version"))
def version_history(spark, sf_dir):
    return state.versions(read(spark, sf_dir, "version"), "product_id", "version_no", "approved_at").select("product_id", "version_id", F.col("version_no").cast("bigint").alias("version_no"), F.col("approved_at").alias("valid_from"), "valid_to", "version_status")


@query(sql("SELECT * EXCLUDE k FROM (SELECT product_id, version_id, CAST(version_no AS BIGINT) AS version_no, row_number() OVER (PARTITION BY product_id ORDER BY approved_at DESC, version_no DESC) AS k FROM version) WHERE k = 1", "version"))
def latest_versions(spark, sf_dir):
    return picks.latest_per_key(read(spark, sf_dir, "version"), ["product_id"], [F.desc("approved_at"), F.desc("version_no")]).select("product_id", "version_id", F.col("version_no").cast("bigint").alias("version_no"))


INCOMING = """
WITH now AS (SELECT * FROM (SELECT product_id, CAST(version_no AS BIGINT) AS version_no, rate_value, note, row_number() OVER (PARTITION BY product_id ORDER BY version_no DESC) AS k FROM version) WHERE k = 1),
incoming AS (SELECT product_id, coalesce(fee, 0) AS rate_value, CASE WHEN status = 'active' THEN 'A' ELSE 'R' END AS note FROM (SELECT product_id, status, coalesce(display_fee, monthly_fee) AS fee FROM product) WHERE product_id NOT LIKE '%9')
"""


@query(sql(INCOMING + """
SELECT product_id, event_type, CASE WHEN event_type = 'New' THEN 1 ELSE old_no + CASE WHEN event_type = 'Updated' THEN 1 ELSE 0 END END AS version_no, changed FROM (
  SELECT product_id, now.version_no AS old_no, CASE WHEN incoming.note IS NULL THEN 'Absent' WHEN now.note IS NULL THEN 'New' WHEN now.rate_value <> incoming.rate_value OR now.note <> incoming.note THEN 'Updated' ELSE 'Touched' END AS event_type,
    CASE WHEN incoming.note IS NULL OR now.note IS NULL THEN NULL ELSE concat_ws(',', CASE WHEN now.rate_value <> incoming.rate_value THEN 'rate_value' END, CASE WHEN now.note <> incoming.note THEN 'note' END) END AS changed
  FROM now FULL JOIN incoming USING (product_id))""", "version", "product"))  # fmt: skip
def product_upsert(spark, sf_dir):
    current = picks.latest_per_key(read(spark, sf_dir, "version"), ["product_id"], [F.desc("version_no")])
    incoming = read(spark, sf_dir, "product").where("product_id NOT LIKE '%9'").select("product_id", F.coalesce("display_fee", "monthly_fee", F.lit(0.0)).alias("rate_value"), F.when(F.col("status") == "active", "A").otherwise("R").alias("note"))
    return state.upsert_versions(current, incoming, "product_id", ["rate_value", "note"]).select("product_id", "event_type", F.col("version_no").cast("bigint").alias("version_no"), F.array_join("changed", ",").alias("changed"))


@query(sql(INCOMING + "SELECT product_id, coalesce(incoming.rate_value, now.rate_value) AS rate_value, coalesce(incoming.note, now.note) AS note FROM now FULL JOIN incoming USING (product_id)", "version", "product"))
def product_merge(spark, sf_dir):
    current = picks.latest_per_key(read(spark, sf_dir, "version"), ["product_id"], [F.desc("version_no")])
    incoming = read(spark, sf_dir, "product").where("product_id NOT LIKE '%9'").select("product_id", F.coalesce("display_fee", "monthly_fee", F.lit(0.0)).alias("rate_value"), F.when(F.col("status") == "active", "A").otherwise("R").alias("note"))
    return state.merged(current, incoming, "product_id", ["rate_value", "note"]).select("product_id", "rate_value", "note")


@query(sql("""
WITH n AS (SELECT task_id, first_value(task_id) OVER (PARTITION BY product_name, bank_code, product_type ORDER BY created_at DESC, task_id DESC) AS superseded_by FROM task WHERE review_state IN ('queued', 'deferred'))
SELECT * FROM n WHERE task_id <> superseded_by""", "task"))
def superseded_tasks(spark, sf_dir):
    """Open tasks that a newer one for the same logical product replaces."""
    open_tasks = read(spark, sf_dir, "task").where("review_state IN ('queued', 'deferred')")
    return state.superseded(open_tasks, ["product_name", "bank_code", "product_type"], [F.desc("created_at"), F.desc("task_id")], "task_id").select("task_id", "superseded_by")


@query(sql("SELECT DISTINCT a.task_id FROM task a JOIN task b ON a.run_id = b.run_id AND a.product_type = b.product_type AND a.bank_code = b.bank_code AND a.task_id <> b.task_id WHERE a.review_state = 'queued' AND b.review_state = 'approved'", "task"))
def covered_by_approved_peer(spark, sf_dir):
    task = read(spark, sf_dir, "task")
    peers = task.where("review_state = 'approved'").select("run_id", "product_type", "bank_code").distinct()
    return task.where("review_state = 'queued'").join(peers, ["run_id", "product_type", "bank_code"], "left_semi").select("task_id")


@query(sql("SELECT task_id, run_id, product_type, CAST(count(*) OVER (PARTITION BY run_id, product_type) AS BIGINT) AS n_like, count(*) OVER (PARTITION BY run_id, product_type) = 1 AS is_unique FROM task", "task"))
def uniqueness_flags(spark, sf_dir):
    """How many tasks share a key, by aggregation and a join, so that a hot key is never one window."""
    task = read(spark, sf_dir, "task")
    counts = task.groupBy("run_id", "product_type").agg(F.count("*").alias("n_like"))
    return task.join(counts, ["run_id", "product_type"]).select("task_id", "run_id", "product_type", "n_like", (F.col("n_like") == 1).alias("is_unique"))


@query(sql(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY refresh_scope, country_code ORDER BY refreshed_at DESC, snapshot_id DESC) <= 2 OR attempted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS kept FROM refresh WHERE refresh_status = 'completed')
SELECT refresh_scope, country_code, CAST(count(*) FILTER (WHERE kept) AS BIGINT) AS n_kept, CAST(count(*) FILTER (WHERE NOT kept) AS BIGINT) AS n_removed FROM r GROUP BY 1, 2""", "refresh"))
def snapshot_retention(spark, sf_dir):
    recent = F.col("attempted_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 14 DAYS")
    kept = state.retained(read(spark, sf_dir, "refresh").where("refresh_status = 'completed'"), ["refresh_scope", "country_code"], [F.desc("refreshed_at"), F.desc("snapshot_id")], 2, recent, "snapshot_id")
    return kept.groupBy("refresh_scope", "country_code").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_removed"))


@query(sql(f"SELECT run_id, CASE WHEN run_state = 'started' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR THEN 'failed' ELSE run_state END AS run_state, CASE WHEN run_state = 'started' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR THEN 'stale' END AS error_summary FROM run", "run"))
def stale_run_recovery(spark, sf_dir):
    stale = (F.col("run_state") == "started") & (F.col("started_at") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 12 HOURS"))
    return read(spark, sf_dir, "run").select("run_id", F.when(stale, "failed").otherwise(F.col("run_state")).alias("run_state"), F.when(stale, "stale").alias("error_summary"))


@query(sql(f"""
WITH keys AS (SELECT DISTINCT 'C' || CAST(o_custkey % 45 AS VARCHAR) AS schedule_key FROM orders), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schedule_key ORDER BY started_at DESC, run_id DESC) AS k FROM run WHERE schedule_key IS NOT NULL) WHERE k = 1),
aged AS (SELECT schedule_key, run_id, run_state, partial_flag, started_at, (epoch(TIMESTAMP '{AS_OF}') - epoch(started_at)) / 3600 AS age FROM keys LEFT JOIN last USING (schedule_key))
SELECT * FROM (SELECT schedule_key, run_id, CASE WHEN started_at IS NULL THEN 'never_run' WHEN age >= 168 THEN 'interval' WHEN (run_state = 'failed' OR partial_flag) AND age >= 24 THEN 'retry' END AS reason FROM aged) WHERE reason IS NOT NULL""", "run"))  # fmt: skip
def due_schedules(spark, sf_dir):
    keys = read(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 45).cast("string")).alias("schedule_key")).distinct()
    return state.due(keys, read(spark, sf_dir, "run"), "schedule_key", AS_OF, 168, 24).select("schedule_key", "run_id", "reason")


@query(sql("""
WITH waiting AS (SELECT * FROM refresh WHERE refresh_status = 'started'), oldest AS (SELECT refresh_scope, country_code, row_number() OVER (ORDER BY min(attempted_at), refresh_scope, country_code) AS k FROM waiting GROUP BY 1, 2)
SELECT waiting.snapshot_id, waiting.refresh_scope, waiting.country_code FROM waiting JOIN oldest USING (refresh_scope, country_code) WHERE k = 1""", "refresh"))
def claimed_refresh_requests(spark, sf_dir):
    """All waiting requests of the scope whose oldest request is the oldest of all."""
    waiting = read(spark, sf_dir, "refresh").where("refresh_status = 'started'")
    scope = waiting.groupBy("refresh_scope", "country_code").agg(F.min("attempted_at").alias("since")).orderBy("since", "refresh_scope", "country_code").limit(1)
    return waiting.join(F.broadcast(scope), ["refresh_scope", "country_code"]).select("snapshot_id", "refresh_scope", "country_code")


@query(sql("SELECT candidate_id, 'V' || substr(candidate_id, 2) AS version_id, f AS field_name FROM (SELECT candidate_id, task_id, unnest(['rate', 'fee', 'term']) AS f FROM task WHERE review_state = 'edited') WHERE NOT (f = 'fee' AND task_id LIKE '%4') AND NOT (f = 'rate' AND task_id LIKE '%7')", "task"))
def cloned_evidence_links(spark, sf_dir):
    """Evidence of a candidate handed to its version, less the fields that an editor overrode."""
    task = read(spark, sf_dir, "task").where("review_state = 'edited'")
    links = task.select("candidate_id", "task_id", F.explode(F.array(*map(F.lit, ("rate", "fee", "term")))).alias("field_name"))
    overridden = task.where("task_id LIKE '%4'").select("candidate_id", F.lit("fee").alias("field_name")).union(task.where("task_id LIKE '%7'").select("candidate_id", F.lit("rate").alias("field_name")))
    return links.join(overridden, ["candidate_id", "field_name"], "left_anti").select("candidate_id", F.concat(F.lit("V"), F.substring("candidate_id", 2, 40)).alias("version_id"), "field_name")


@query(sql("SELECT run_id, run_state, partial_flag, run_state = 'failed' OR (run_state = 'completed' AND partial_flag) AS may_retry, CASE WHEN run_state = 'started' THEN 'still_running' WHEN run_state = 'completed' AND NOT partial_flag THEN 'complete' END AS refused FROM run", "run"))
def run_retry_eligibility(spark, sf_dir):
    state_, partial = F.col("run_state"), F.col("partial_flag")
    return read(spark, sf_dir, "run").select("run_id", "run_state", "partial_flag", ((state_ == "failed") | ((state_ == "completed") & partial)).alias("may_retry"), F.when(state_ == "started", "still_running").when((state_ == "completed") & ~partial, "complete").alias("refused"))


@query(sql("""
WITH m AS (SELECT task_id, coalesce(e.product_id, n.product_id) AS product_id, CASE WHEN e.product_id IS NOT NULL THEN 'explicit' WHEN n.product_id IS NOT NULL THEN 'name' END AS matched_by FROM task
  LEFT JOIN product e ON e.product_id = 'P' || substr(task_id, 2) AND e.bank_code = task.bank_code
  LEFT JOIN (SELECT bank_code, product_type, min(product_id) AS product_id FROM product GROUP BY 1, 2 HAVING count(*) = 1) n ON n.bank_code = task.bank_code AND n.product_type = lower(task.product_type))
SELECT * FROM m WHERE matched_by IS NOT NULL""", "task", "product"))
def matched_products(spark, sf_dir):
    """The product that a task is about: by its explicit id, else by a name that one product alone has."""
    task, product = read(spark, sf_dir, "task"), read(spark, sf_dir, "product")
    explicit = product.select(F.concat(F.lit("T"), F.substring("product_id", 2, 40)).alias("task_id"), "bank_code", F.col("product_id").alias("e"))
    unique = product.groupBy("bank_code", "product_type").agg(F.min("product_id").alias("n"), F.count("*").alias("c")).where("c = 1").select("bank_code", F.col("product_type").alias("kind"), "n")
    joined = task.join(explicit, ["task_id", "bank_code"], "left").join(unique.withColumnRenamed("bank_code", "b"), (F.col("bank_code") == F.col("b")) & (F.lower("product_type") == F.col("kind")), "left")
    return joined.select("task_id", F.coalesce("e", "n").alias("product_id"), F.when(F.col("e").isNotNull(), "explicit").when(F.col("n").isNotNull(), "name").alias("matched_by")).where("matched_by IS NOT NULL")
