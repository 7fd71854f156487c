"""Operations: review queue, runs, changes, usage, registry, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators import picks, state
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query(sql("""
SELECT task_id, review_state, validation_status, confidence, rank FROM (SELECT *, row_number() OVER (ORDER BY CASE review_state WHEN 'queued' THEN 0 WHEN 'deferred' THEN 1 ELSE 2 END,
  CASE validation_status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence ASC NULLS LAST, created_at DESC, task_id) AS rank
FROM task WHERE review_state IN ('queued', 'deferred') AND (product_name ILIKE '%00%' OR product_type ILIKE '%00%')) WHERE rank <= 40""", "task"))  # fmt: skip
def review_queue(spark, sf_dir):
    """Open tasks by state, severity, confidence and age, under a search whose wildcards are live."""
    tasks = read(spark, sf_dir, "task").where(F.col("review_state").isin("queued", "deferred") & (F.col("product_name").ilike("%00%") | F.col("product_type").ilike("%00%")))
    order = [F.expr("CASE review_state WHEN 'queued' THEN 0 WHEN 'deferred' THEN 1 ELSE 2 END"), F.expr("CASE validation_status WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"), F.col("confidence").asc_nulls_last(), F.desc("created_at"), F.asc("task_id")]
    return picks.ranking(tasks, order, 40, 1).select("task_id", "review_state", "validation_status", "confidence", F.col("rank").cast("bigint").alias("rank"))


@query(sql("SELECT 'state' AS kind, review_state AS code, CAST(count(*) AS BIGINT) AS n FROM task GROUP BY 2 UNION ALL SELECT 'status', validation_status, CAST(count(*) AS BIGINT) FROM task GROUP BY 2", "task"))
def review_queue_counts(spark, sf_dir):
    tasks = read(spark, sf_dir, "task")
    codes = F.array(F.struct(F.lit("state").alias("kind"), F.col("review_state").alias("code")), F.struct(F.lit("status").alias("kind"), F.col("validation_status").alias("code")))
    return tasks.select(F.inline(codes)).groupBy("kind", "code").agg(F.count("*").alias("n"))


@query(sql("""
WITH items AS (SELECT run_id, count(*) AS n_items, count(*) FILTER (WHERE stage_status = 'failed') AS n_failed FROM run_item GROUP BY 1)
SELECT run_id, run_state, coalesce(trigger_type, 'unknown') AS trigger_type, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  CASE WHEN coalesce(n_items, 0) > 0 AND n_items = n_failed THEN 'failed' WHEN n_failed > 0 THEN 'partial' ELSE 'completed' END AS rolled_up FROM run LEFT JOIN items USING (run_id)
WHERE started_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01' AND partial_flag""", "run", "run_item"))
def run_list(spark, sf_dir):
    """Runs of a period that ended in part, each with the count of its items and what they add up to."""
    items = read(spark, sf_dir, "run_item").groupBy("run_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("stage_status") == "failed").alias("n_failed"))
    runs = read(spark, sf_dir, "run").where(F.col("partial_flag") & F.col("started_at").between("1996-01-01", "1998-01-01"))
    state = F.when((F.coalesce("n_items", F.lit(0)) > 0) & (F.col("n_items") == F.col("n_failed")), "failed").when(F.col("n_failed") > 0, "partial").otherwise("completed")
    return runs.join(items, "run_id", "left").select("run_id", "run_state", F.coalesce("trigger_type", F.lit("unknown")).alias("trigger_type"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), state.alias("rolled_up"))


@query(sql("SELECT coalesce(trigger_type, 'unknown') || '/' || run_state AS run_type, CAST(count(*) AS BIGINT) AS n FROM run GROUP BY 1", "run"))
def run_type_counts(spark, sf_dir):
    return read(spark, sf_dir, "run").groupBy(F.concat_ws("/", F.coalesce("trigger_type", F.lit("unknown")), "run_state").alias("run_type")).agg(F.count("*").alias("n"))


@query(sql("""
SELECT run_id, stage_name, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE stage_status = 'completed') AS BIGINT) AS n_completed, min(started_at) AS first_at, max(started_at) AS last_at,
  CASE WHEN count(*) FILTER (WHERE stage_status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE stage_status = 'failed') > 0 THEN 'degraded' ELSE 'completed' END AS stage_state
FROM run_item GROUP BY 1, 2""", "run_item"))
def run_stage_summary(spark, sf_dir):
    failed = F.count_if(F.col("stage_status") == "failed")
    state = F.when(failed == F.count("*"), "failed").when(failed > 0, "degraded").otherwise("completed")
    return read(spark, sf_dir, "run_item").groupBy("run_id", "stage_name").agg(F.count("*").alias("n"), F.count_if(F.col("stage_status") == "completed").alias("n_completed"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), state.alias("stage_state"))


@query(sql("""
SELECT run_id, string_agg(stage_name || ':' || n, ',' ORDER BY stage_name) AS histogram FROM (SELECT run_id, stage_name, CAST(count(*) AS VARCHAR) AS n FROM run_item WHERE stage_status = 'failed' GROUP BY 1, 2) GROUP BY 1""", "run_item"))
def run_failure_histogram(spark, sf_dir):
    """A map of failures by stage for each run, written out in order of its keys."""
    counts = read(spark, sf_dir, "run_item").where("stage_status = 'failed'").groupBy("run_id", "stage_name").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("stage_name", "n")))))
    return counts.groupBy("run_id").agg(pairs.alias("pairs")).select("run_id", F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["key"], p["value"])), ",").alias("histogram"))


@query(sql("""
SELECT run_id, item_no, stage_name, error_count, warning_count, started_at, rank FROM (SELECT *, row_number() OVER (ORDER BY CASE stage_status WHEN 'failed' THEN 0 ELSE 1 END, error_count DESC, warning_count DESC, started_at DESC, run_id, item_no, stage_name) AS rank FROM run_item) WHERE rank <= 25""", "run_item"))
def run_error_events(spark, sf_dir):
    order = [F.expr("CASE stage_status WHEN 'failed' THEN 0 ELSE 1 END"), F.desc("error_count"), F.desc("warning_count"), F.desc("started_at"), F.asc("run_id"), F.asc("item_no"), F.asc("stage_name")]
    return picks.ranking(read(spark, sf_dir, "run_item"), order, 25, 1).select("run_id", "item_no", "stage_name", "error_count", "warning_count", "started_at", F.col("rank").cast("bigint").alias("rank"))


@query(sql("""
WITH newest AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY version_no DESC) AS k FROM version)
SELECT change_id, change.product_id, event_type, coalesce(product_name, 'unknown') AS product_name, CASE WHEN event_type = 'ManualOverride' THEN version_id END AS override_version
FROM change LEFT JOIN product ON product.product_id = change.product_id LEFT JOIN newest ON newest.product_id = change.product_id AND k = 1 AND event_type = 'ManualOverride'""", "change", "product", "version"))  # fmt: skip
def change_history(spark, sf_dir):
    """Changes with the product's name, and for overrides alone its newest version."""
    newest = picks.latest_per_key(read(spark, sf_dir, "version"), ["product_id"], [F.desc("version_no")]).select("product_id", F.col("version_id").alias("override_version"), F.lit("ManualOverride").alias("event_type"))
    named = read(spark, sf_dir, "product").select("product_id", "product_name")
    return read(spark, sf_dir, "change").join(named, "product_id", "left").join(newest, ["product_id", "event_type"], "left").select("change_id", "product_id", "event_type", F.coalesce("product_name", F.lit("unknown")).alias("product_name"), "override_version")


@query(sql("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT product_id) AS BIGINT) AS n_products, max(detected_at) AS last_at FROM change GROUP BY 1", "change"))
def change_counts(spark, sf_dir):
    return read(spark, sf_dir, "change").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("n_products"), F.max("detected_at").alias("last_at"))


USAGE = "CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT run_id) AS BIGINT) AS n_runs, CAST(count(DISTINCT candidate_id) AS BIGINT) AS n_candidates"


def sums() -> list:
    return [F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens"), F.sum("cost_micros").cast("bigint").alias("cost_micros"), F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("candidate_id").alias("n_candidates")]


@query(sql(f"""SELECT {USAGE}, CAST(count(DISTINCT provider_name || '/' || model_name) AS BIGINT) AS n_models, min(recorded_at) AS first_at, max(recorded_at) AS last_at,
  CAST(count(*) FILTER (WHERE prompt_tokens + completion_tokens = 0) AS BIGINT) AS n_zero, round(CAST(sum(prompt_tokens + completion_tokens) AS DOUBLE) / count(*), 2) AS tokens_each FROM usage""", "usage"))
def usage_totals(spark, sf_dir):
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    return read(spark, sf_dir, "usage").agg(*sums(), F.count_distinct("provider_name", "model_name").alias("n_models"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.count_if(tokens == 0).alias("n_zero"), F.round(F.sum(tokens).cast("double") / F.count("*"), 2).alias("tokens_each"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """``share_percent`` of each group in the total of ``column``; groups are few rows by now."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share_percent", F.round(F.col(column) * 100.0 / F.col("_total"), 2)).drop("_total")


def usage_by(spark, sf_dir, *keys: str, names: str) -> DataFrame:
    groups = read(spark, sf_dir, "usage").groupBy(*keys).agg(*sums(), F.array_join(F.array_sort(F.collect_set(names)), ",").alias("names"))
    return shares(groups, "tokens")


def usage_sql(keys: str, names: str) -> str:
    return sql(f"SELECT *, round(tokens * 100.0 / sum(tokens) OVER (), 2) AS share_percent FROM (SELECT {keys}, {USAGE}, string_agg(DISTINCT {names}, ',' ORDER BY {names}) AS names FROM usage GROUP BY {keys})", "usage")


@query(usage_sql("provider_name, model_name", "agent_name"))
def usage_by_model(spark, sf_dir):
    return usage_by(spark, sf_dir, "provider_name", "model_name", names="agent_name")


@query(usage_sql("agent_name", "provider_name"))
def usage_by_agent(spark, sf_dir):
    return usage_by(spark, sf_dir, "agent_name", names="provider_name")


@query(sql(f"SELECT run_id, {USAGE}, CASE WHEN count(DISTINCT agent_name) = 1 THEN min(agent_name) ELSE 'multiple' END AS scope FROM usage GROUP BY 1", "usage"))
def usage_by_run(spark, sf_dir):
    return read(spark, sf_dir, "usage").groupBy("run_id").agg(*sums(), F.when(F.count_distinct("agent_name") == 1, F.min("agent_name")).otherwise("multiple").alias("scope"))


@query(sql("""
WITH days AS (SELECT CAST(recorded_at AS DATE) AS day, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens FROM usage GROUP BY 1),
steps AS (SELECT *, lag(tokens) OVER (ORDER BY day) AS before FROM days),
deltas AS (SELECT *, tokens - before AS delta, CASE WHEN before IS NULL THEN NULL WHEN before = 0 THEN CASE WHEN tokens > 0 THEN 100.0 ELSE 0.0 END ELSE round((tokens - before) * 100.0 / before, 2) END AS percent FROM steps)
SELECT day, tokens, delta, percent, CASE WHEN before IS NULL THEN 'baseline' WHEN tokens = 0 THEN 'idle' WHEN percent >= 50 THEN 'spike' WHEN percent >= 20 THEN 'elevated' WHEN percent <= -20 THEN 'down' ELSE 'stable' END AS trend FROM deltas""", "usage"))  # fmt: skip
def usage_trend(spark, sf_dir):
    """Daily totals against the day before. The window runs over days, which are few however many rows they sum."""
    days = read(spark, sf_dir, "usage").groupBy(F.to_date("recorded_at").alias("day")).agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens"))
    before, tokens = F.lag("tokens").over(Window.partitionBy(F.lit(0)).orderBy("day")), F.col("tokens")
    steps = days.withColumn("before", before).withColumn("delta", tokens - F.col("before"))
    percent = F.when(F.col("before").isNull(), None).when(F.col("before") == 0, F.when(tokens > 0, 100.0).otherwise(0.0)).otherwise(F.round(F.col("delta") * 100.0 / F.col("before"), 2))
    trend = F.when(F.col("before").isNull(), "baseline").when(tokens == 0, "idle").when(F.col("percent") >= 50, "spike").when(F.col("percent") >= 20, "elevated").when(F.col("percent") <= -20, "down").otherwise("stable")
    return steps.withColumn("percent", percent).select("day", "tokens", "delta", "percent", trend.alias("trend"))


@query(sql("""
WITH t AS (SELECT usage_id, prompt_tokens + completion_tokens AS tokens, cost_micros FROM usage),
lim AS (SELECT greatest(1000, ceil(avg(tokens) + stddev_pop(tokens))) AS token_limit, greatest(250, avg(cost_micros) + stddev_pop(cost_micros)) AS cost_limit FROM t)
SELECT usage_id, CAST(tokens AS BIGINT) AS tokens, signals, CAST(rank AS BIGINT) AS rank FROM (SELECT usage_id, tokens, concat_ws(',', CASE WHEN tokens >= token_limit THEN 'high_tokens' END, CASE WHEN cost_micros >= cost_limit THEN 'high_cost' END, CASE WHEN tokens = 0 THEN 'zero_tokens' END) AS signals,
  row_number() OVER (ORDER BY (CASE WHEN tokens >= token_limit THEN 1 ELSE 0 END + CASE WHEN cost_micros >= cost_limit THEN 1 ELSE 0 END + CASE WHEN tokens = 0 THEN 1 ELSE 0 END) DESC, tokens DESC, usage_id) AS rank
  FROM t, lim WHERE tokens >= token_limit OR cost_micros >= cost_limit OR tokens = 0) WHERE rank <= 20""", "usage"))  # fmt: skip
def usage_anomalies(spark, sf_dir):
    """The first twenty rows beyond mean plus deviation, by the number of signals. Limits are one row, aggregated first."""
    rows = read(spark, sf_dir, "usage").select("usage_id", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), "cost_micros")
    limits = rows.agg(F.greatest(F.lit(1000), F.ceil(F.avg("tokens") + F.stddev_pop("tokens"))).alias("token_limit"), F.greatest(F.lit(250.0), F.avg("cost_micros") + F.stddev_pop("cost_micros")).alias("cost_limit"))
    flags = {"high_tokens": F.col("tokens") >= F.col("token_limit"), "high_cost": F.col("cost_micros") >= F.col("cost_limit"), "zero_tokens": F.col("tokens") == 0}
    marked = rows.crossJoin(F.broadcast(limits)).withColumn("signals", F.concat_ws(",", *[F.when(v, k) for k, v in flags.items()])).withColumn("score", sum((v.cast("int") for v in flags.values()), F.lit(0)))
    return picks.ranking(marked.where("score > 0"), [F.desc("score"), F.desc("tokens"), F.asc("usage_id")], 20, 1).select("usage_id", F.col("tokens").cast("bigint").alias("tokens"), "signals", F.col("rank").cast("bigint").alias("rank"))


@query(sql("""
SELECT bank.bank_code, bank.country_code, CAST(count(product_id) AS BIGINT) AS n_products, CAST(count(DISTINCT product_type) AS BIGINT) AS n_types, coalesce(string_agg(DISTINCT product_type, ',' ORDER BY product_type) FILTER (WHERE product.status = 'active'), '') AS types
FROM bank LEFT JOIN product ON product.bank_code = bank.bank_code AND product.country_code = bank.country_code GROUP BY 1, 2""", "bank", "product"))  # fmt: skip
def bank_catalogue(spark, sf_dir):
    """Banks with their products by the composite key, and the types on offer as an ordered list."""
    bank, product = read(spark, sf_dir, "bank").select("bank_code", "country_code"), read(spark, sf_dir, "product").select("bank_code", "country_code", "product_id", "product_type", "status")
    types = F.collect_set(F.when(F.col("status") == "active", F.col("product_type")))
    return bank.join(product, ["bank_code", "country_code"], "left").groupBy("bank_code", "country_code").agg(F.count("product_id").alias("n_products"), F.count_distinct("product_type").alias("n_types"), F.array_join(F.array_sort(types), ",").alias("types"))


@query(sql("SELECT product_type, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT coalesce(subtype_code, 'none'), ',' ORDER BY coalesce(subtype_code, 'none')) AS subtypes FROM product WHERE lower(product_name) LIKE '%r%' AND product_family <> 'lending' GROUP BY 1", "product"))
def registry_summary(spark, sf_dir):
    return read(spark, sf_dir, "product").where(F.lower("product_name").like("%r%") & (F.col("product_family") != "lending")).groupBy("product_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.coalesce("subtype_code", F.lit("none")))), ",").alias("subtypes"))


@query(sql("SELECT user_id, CAST(count(*) AS BIGINT) AS n_failed FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1 HAVING count(*) >= 2"))
def recent_failures(spark, sf_dir):
    """Users with several errors in the day before a given moment."""
    until = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return read(spark, sf_dir, "events").where((F.col("event_type") == "error") & F.col("ts").between(until - F.expr("INTERVAL 24 HOURS"), until)).groupBy("user_id").agg(F.count("*").alias("n_failed")).where("n_failed >= 2")


@query(sql("SELECT CAST((SELECT count(*) FROM product WHERE bank_code = 'B3') AS BIGINT) AS n_products, CAST((SELECT count(*) FROM task WHERE bank_code = 'B3') AS BIGINT) AS n_tasks, CAST((SELECT count(*) FROM version WHERE product_id IN (SELECT product_id FROM product WHERE bank_code = 'B3')) AS BIGINT) AS n_versions", "product", "task", "version"))
def bank_dependencies(spark, sf_dir):
    """What hangs on a bank, as one row of counts."""
    products = read(spark, sf_dir, "product").where("bank_code = 'B3'")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(products, "n_products").crossJoin(count(read(spark, sf_dir, "task").where("bank_code = 'B3'"), "n_tasks")).crossJoin(count(read(spark, sf_dir, "version").join(products, "product_id", "left_semi"), "n_versions"))


@query(sql("""
SELECT task_id, CASE WHEN bank_name IS NOT NULL AND product_type <> '' THEN bank_name || ' / ' || product_type WHEN product_type <> '' THEN product_type ELSE task_id END AS target, coalesce(nullif(triggered_by, ''), 'system') AS actor
FROM task LEFT JOIN bank ON bank.bank_code = coalesce(task.bank_code, 'B0') LEFT JOIN run ON run.run_id = task.run_id""", "task", "bank", "run"))
def audit_log(spark, sf_dir):
    """Tasks with a display name of what they target, by a join on a coalesced key, and who set them off."""
    task, bank, run = read(spark, sf_dir, "task"), read(spark, sf_dir, "bank").select(F.col("bank_code").alias("own_code"), "bank_name"), read(spark, sf_dir, "run").select("run_id", "triggered_by")
    target = F.when(F.col("bank_name").isNotNull() & (F.col("product_type") != ""), F.concat_ws(" / ", "bank_name", "product_type")).when(F.col("product_type") != "", F.col("product_type")).otherwise(F.col("task_id"))
    return task.join(bank, F.coalesce("bank_code", F.lit("B0")) == F.col("own_code"), "left").join(run, "run_id", "left").select("task_id", target.alias("target"), F.coalesce(F.nullif(F.col("triggered_by"), F.lit("")), F.lit("system")).alias("actor"))


@query(sql("SELECT run_id FROM run_item GROUP BY 1 HAVING count(DISTINCT stage_name) = 3", "run_item"))
def runs_with_all_stages(spark, sf_dir):
    return read(spark, sf_dir, "run_item").groupBy("run_id").agg(F.count_distinct("stage_name").alias("n")).where("n = 3").select("run_id")


@query(sql("""
SELECT task_id FROM task WHERE validation_status = 'pass' AND EXISTS (SELECT 1 FROM run_item WHERE run_item.run_id = task.run_id AND stage_status = 'completed')
AND NOT EXISTS (SELECT 1 FROM change WHERE change.product_id = 'P' || substr(task.task_id, 2) AND event_type = 'ManualOverride') AND bank_code IN (SELECT bank_code FROM bank WHERE status = 'active')""", "task", "run_item", "change", "bank"))  # fmt: skip
def promotable_tasks(spark, sf_dir):
    """Tasks with a completed item, of an active bank, and without an override: semi and anti joins."""
    task = read(spark, sf_dir, "task").where("validation_status = 'pass'")
    overrides = read(spark, sf_dir, "change").where("event_type = 'ManualOverride'").select(F.concat(F.lit("T"), F.substring("product_id", 2, 40)).alias("task_id"))
    return task.join(read(spark, sf_dir, "run_item").where("stage_status = 'completed'"), "run_id", "left_semi").join(overrides, "task_id", "left_anti").join(read(spark, sf_dir, "bank").where("status = 'active'"), "bank_code", "left_semi").select("task_id")


@query(sql("SELECT bank_code, country_code, t.product_type FROM bank CROSS JOIN (SELECT DISTINCT product_type FROM product) t WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.bank_code = bank.bank_code AND p.product_type = t.product_type)", "bank", "product"))
def coverage_gaps(spark, sf_dir):
    """Every active bank with every product type, less what is there."""
    product, bank = read(spark, sf_dir, "product"), read(spark, sf_dir, "bank").select("bank_code", "country_code")
    return bank.crossJoin(product.select("product_type").distinct()).join(product, ["bank_code", "product_type"], "left_anti").select("bank_code", "country_code", "product_type")


@query(sql("SELECT bank_code AS code FROM product WHERE status = 'active' UNION SELECT bank_code FROM task UNION SELECT bank_code FROM bank", "product", "task", "bank"))
def known_bank_codes(spark, sf_dir):
    part = lambda name: read(spark, sf_dir, name).select(F.col("bank_code").alias("code"))
    return read(spark, sf_dir, "product").where("status = 'active'").select(F.col("bank_code").alias("code")).union(part("task")).union(part("bank")).distinct()


@query(sql("""
SELECT a.run_id, a.schedule_key, a.started_at, b.run_id AS next_run_id FROM run a JOIN run b ON a.schedule_key = b.schedule_key AND a.run_state = 'failed' AND b.run_state = 'completed' AND (b.started_at > a.started_at OR (b.started_at = a.started_at AND b.run_id > a.run_id)) AND b.started_at <= a.started_at + INTERVAL 20 DAY""", "run"))
def run_recoveries(spark, sf_dir):
    """Failed runs with the completed ones that followed within twenty days on the same schedule."""
    run = read(spark, sf_dir, "run")
    a = run.where("run_state = 'failed'").select("run_id", "schedule_key", "started_at")
    b = run.where("run_state = 'completed'").select(F.col("run_id").alias("next_run_id"), "schedule_key", F.col("started_at").alias("next_at"))
    later = (F.col("next_at") > F.col("started_at")) | ((F.col("next_at") == F.col("started_at")) & (F.col("next_run_id") > F.col("run_id")))
    return state.followed(a, b, "schedule_key", "started_at", "next_at", 20, later).select("run_id", "schedule_key", "started_at", "next_run_id")


@query(sql("SELECT product_id FROM product WHERE subtype_code IS DISTINCT FROM 'standard' AND (bank_code, product_id) > ('B5', 'P5') AND regexp_matches(product_name, '^(red|blue) [a-z]+$')", "product"))
def null_safe_and_row_filters(spark, sf_dir):
    return read(spark, sf_dir, "product").where(~F.col("subtype_code").eqNullSafe("standard") & (F.struct("bank_code", "product_id") > F.struct(F.lit("B5"), F.lit("P5"))) & F.col("product_name").rlike("^(red|blue) [a-z]+$")).select("product_id")


@query(sql("""
SELECT run_id, CAST(count(*) AS BIGINT) AS n, '[' || string_agg('{"item":' || item_no || ',"stage":"' || stage_name || '"}', ',' ORDER BY item_no, stage_name, started_at) || ']' AS trace FROM run_item WHERE error_count > 1 GROUP BY 1""", "run_item"))
def evidence_trace(spark, sf_dir):
    """Items of each run as one JSON list, in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col("item_no").alias("item"), F.col("stage_name").alias("stage"), "started_at")))
    return read(spark, sf_dir, "run_item").where("error_count > 1").groupBy("run_id").agg(F.count("*").alias("n"), items.alias("items")).select("run_id", "n", F.to_json(F.transform("items", lambda i: F.struct(i["item"].alias("item"), i["stage"].alias("stage")))).alias("trace"))
