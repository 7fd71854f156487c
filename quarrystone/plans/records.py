r"""JSON payloads as relations, refresh metadata, exports, lineage, and lists as users ask for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import filters
from quarrystone.functions import text as tx
from quarrystone.operators import picks, state
from quarrystone.plans import lifecycle, public
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql


@query(sql("""SELECT product_id, name, TRY_CAST(value AS DOUBLE) AS number, value IS NULL AS missing FROM (SELECT product_id, unnest(from_json(fields, '[{"name":"VARCHAR","value":"VARCHAR"}]'), recursive := true) FROM payload)""", "payload"))
def inlined_fields(spark, sf_dir):
    """Rows of a JSON list, typed where they cast."""
    rows = F.from_json("fields", "array<struct<name: string, value: string>>")
    return read(spark, sf_dir, "payload").select("product_id", F.inline(rows)).select("product_id", "name", F.col("value").try_cast("double").alias("number"), F.col("value").isNull().alias("missing"))


@query(sql("SELECT product_id, CASE WHEN version_payload IS NOT NULL AND version_payload <> '{}' THEN 'version' ELSE 'current' END AS origin, json_extract_string(CASE WHEN version_payload IS NOT NULL AND version_payload <> '{}' THEN version_payload ELSE payload END, '$.rate') AS rate FROM payload", "payload"))
def chosen_payloads(spark, sf_dir):
    """The version's payload where it holds anything, else the current one."""
    own = F.coalesce(F.col("version_payload") != "{}", F.lit(False))
    chosen = F.coalesce(F.when(own, F.col("version_payload")), F.col("payload"), F.lit("{}"))
    return read(spark, sf_dir, "payload").select("product_id", F.when(own, "version").otherwise("current").alias("origin"), F.get_json_object(chosen, "$.rate").alias("rate"))


@query(sql("""
WITH b AS (SELECT product_id, unnest(['fee', 'name', 'note', 'rate']) AS k, payload, coalesce(version_payload, '{}') AS v FROM payload), m AS (SELECT product_id, k, CASE k WHEN 'name' THEN upper(json_extract_string(payload, '$.name')) ELSE coalesce(json_extract_string(v, '$.' || k), json_extract_string(payload, '$.' || k)) END AS x FROM b)
SELECT product_id, string_agg(k || '=' || x, ';' ORDER BY k) AS merged FROM m WHERE x IS NOT NULL GROUP BY 1""", "payload"))  # fmt: skip
def merged_payloads(spark, sf_dir):
    """Two JSON objects as one, the second one's keys winning, with one path set anew."""
    base, over = F.from_json("payload", "map<string, string>"), F.coalesce(F.from_json("version_payload", "map<string, string>"), F.create_map().cast("map<string, string>"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k) & (k != "flags"))
    both = F.transform_values(F.map_concat(kept, over), lambda k, v: F.when(k == "name", F.upper(v)).otherwise(v))
    return read(spark, sf_dir, "payload").select("product_id", F.array_join(F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged"))


@query(sql("""
WITH f AS (SELECT product_id, CAST(json_extract(payload, '$.flags') AS VARCHAR[]) AS flags FROM payload)
SELECT product_id, len(flags) AS n_flags, list_contains(flags, 'online') AS online, len(list_intersect(flags, ['app', 'branch'])) > 0 AS any_of, array_to_string(list_sort(list_intersect(flags, ['online', 'phone'])), ',') AS common, array_to_string(list_sort([x for x in flags if x NOT IN ('online', 'phone')]), ',') AS others FROM f""", "payload"))
def payload_flags(spark, sf_dir):
    """Arrays inside JSON: their size, whether they hold a value or any of some, and how they differ from a set."""
    flags, known = F.col("flags"), F.array(F.lit("online"), F.lit("phone"))
    return read(spark, sf_dir, "payload").select("product_id", F.from_json(F.get_json_object("payload", "$.flags"), "array<string>").alias("flags")).select(
        "product_id", F.size(flags).alias("n_flags"), F.exists(flags, lambda x: x == "online").alias("online"), F.arrays_overlap(flags, F.array(F.lit("app"), F.lit("branch"))).alias("any_of"), F.array_join(F.array_sort(F.array_intersect(flags, known)), ",").alias("common"), F.array_join(F.array_sort(F.array_except(flags, known)), ",").alias("others")
    )


@query(sql("""
SELECT product_id, concat_ws(';', 'eligibility_text=' || nullif(tags, ''), 'standard_rate=' || CAST(CAST(posted_rate AS DECIMAL(9, 2)) AS VARCHAR), 'base_12_month_rate=' || CAST(CAST(CASE WHEN posted_rate IS NULL AND term_length_days BETWEEN 330 AND 395 THEN direct_rate ELSE posted_rate END AS DECIMAL(9, 2)) AS VARCHAR), 'included_transactions=' || CAST(CAST(minimum_balance AS BIGINT) % 40 AS VARCHAR),
  'redeemable_flag=' || CASE WHEN term_length_days IS NOT NULL THEN CASE WHEN term_length_days > 700 THEN 'true' ELSE 'false' END END) AS metadata FROM product""", "product"))  # fmt: skip
def refresh_metadata(spark, sf_dir):
    """What a refresh keeps of a product, by kind: texts, numbers, whole numbers, flags; missing ones are left out, and the yearly rate is derived from a term of about a year."""
    year = F.when(F.col("posted_rate").isNull() & F.col("term_length_days").between(330, 395), F.col("direct_rate")).otherwise(F.col("posted_rate"))
    kinds = {"eligibility_text": F.nullif(F.col("tags"), F.lit("")), "standard_rate": F.col("posted_rate").cast("decimal(9,2)"), "base_12_month_rate": year.cast("decimal(9,2)"), "included_transactions": F.col("minimum_balance").cast("bigint") % 40, "redeemable_flag": F.col("term_length_days") > 700}
    pairs = F.map_filter(F.create_map(*[x for name, value in kinds.items() for x in (F.lit(name), value.cast("string"))]), lambda k, v: v.isNotNull())
    return read(spark, sf_dir, "product").select("product_id", F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@query(sql("SELECT product_id, CAST(replace(replace(verified_at, 'T', ' '), 'Z', '+00:00') AS TIMESTAMP) AS verified_at, round((epoch(TIMESTAMP '2026-12-31 00:00:00') - epoch(CAST(replace(replace(verified_at, 'T', ' '), 'Z', '+00:00') AS TIMESTAMP))) / 86400, 4) AS days_ago FROM payload", "payload"))
def verification_age(spark, sf_dir):
    """When a product was verified, from ISO text with or without a zone (none is UTC), and how many days ago."""
    at = F.try_to_timestamp("verified_at")
    days = (F.unix_micros(F.lit("2026-12-31 00:00:00").cast("timestamp")) - F.unix_micros(at)) / 86400e6
    return read(spark, sf_dir, "payload").select("product_id", at.alias("verified_at"), F.round(days, 4).alias("days_ago"))


#: Products of one part of a bank's export.
PART = 100


@query(sql(f"""
WITH e AS (SELECT product_id, '[' || string_agg('{{"no":' || version_no || ',"note":"' || note || '"}}', ',' ORDER BY version_no) || ']' AS evidence FROM version GROUP BY 1),
p AS (SELECT bank_code, product_id, count(*) OVER (PARTITION BY bank_code) AS n, (row_number() OVER (PARTITION BY bank_code ORDER BY product_id) - 1) // {PART} AS part, '{{"product_id":"' || product_id || '","evidence":' || coalesce(evidence, '[]') || '}}' AS own FROM product LEFT JOIN e USING (product_id) WHERE status = 'active')
SELECT bank_code, CAST(part AS BIGINT) AS part, CAST(n AS BIGINT) AS n, '[' || string_agg(own, ',' ORDER BY product_id) || ']' AS export FROM p GROUP BY 1, 2, 3""", "product", "version"))  # fmt: skip
def result_export(spark, sf_dir):
    """Each bank's export: its active products in order with all their evidence nested, and how many they are; as JSON lists of ``PART`` products, which follow one another."""
    row = F.struct(F.col("version_no").alias("no"), "note")
    evidence = read(spark, sf_dir, "version").groupBy("product_id").agg(F.array_sort(F.collect_list(row)).alias("evidence"))
    products = picks.placed(read(spark, sf_dir, "product").where("status = 'active'").select("bank_code", "product_id"), "bank_code", "product_id")
    own = F.struct("product_id", F.coalesce("evidence", F.array().cast("array<struct<no: int, note: string>>")).alias("evidence"))
    rows = products.join(evidence, "product_id", "left").select("bank_code", F.floor(F.col("place") / PART).alias("part"), "n", own.alias("own"))
    return rows.groupBy("bank_code", "part", "n").agg(F.to_json(F.array_sort(F.collect_list("own"))).alias("export"))


@query(sql("""
WITH v AS (SELECT product_id, max(version_no) AS current_version_no FROM version GROUP BY 1)
SELECT change_id, product.product_id, version.version_id, bank.bank_name, refresh.snapshot_id FROM change JOIN product USING (product_id) LEFT JOIN v ON v.product_id = product.product_id LEFT JOIN version ON version.product_id = product.product_id AND version.version_no = v.current_version_no
JOIN bank ON bank.bank_code = product.bank_code AND bank.country_code = product.country_code LEFT JOIN refresh ON refresh.snapshot_id = 'S' || substr(change.change_id, 2)""", "change", "product", "version", "bank", "refresh"))  # fmt: skip
def change_lineage(spark, sf_dir):
    """A change back to its product, that one's current version by number, its bank, and the snapshot that showed it."""
    current = read(spark, sf_dir, "version").groupBy("product_id").agg(F.max_by("version_id", "version_no").alias("version_id"))
    product = read(spark, sf_dir, "product").select("product_id", "bank_code", "country_code").join(current, "product_id", "left")
    bank = read(spark, sf_dir, "bank").select("bank_code", "country_code", F.col("bank_name"))
    refresh = read(spark, sf_dir, "refresh").select("snapshot_id", F.concat(F.lit("E"), F.substring("snapshot_id", 2, 40)).alias("change_id"))
    return read(spark, sf_dir, "change").select("change_id", "product_id").join(product, "product_id").join(bank, ["bank_code", "country_code"]).join(refresh, "change_id", "left").select("change_id", "product_id", "version_id", "bank_name", "snapshot_id")


RUN_SORTS = {"started_at": "started_at", "run_state": "run_state"}


@query(sql("SELECT run_id, run_state, CAST(row_number() OVER (ORDER BY started_at DESC, run_id) AS BIGINT) AS place FROM run WHERE run_state IN ('failed', 'completed') QUALIFY place <= 100", "run"))
def asked_runs(spark, sf_dir):
    """A list under parameters as a user may give them: doubled, unknown, in any case, beyond the limits."""
    asked = filters.normalised(states=[" Failed ", "bogus", "failed", "COMPLETED"], sort_by="nothing", sort_order="DOWN", sorts=RUN_SORTS, page=-3, page_size=5000)
    runs = picks.optional(read(spark, sf_dir, "run"), {"run_state": list(asked.states)})
    return picks.ranking(runs, filters.ordering(asked, RUN_SORTS, "run_id"), asked.page_size, 1).select("run_id", "run_state", F.col("rank").cast("bigint").alias("place"))


@query(sql(f"""
WITH keys AS (SELECT DISTINCT 'C' || CAST(o_custkey % 45 AS VARCHAR) AS schedule_key FROM orders), last AS (SELECT schedule_key, max(started_at) AS started_at FROM run WHERE schedule_key IS NOT NULL GROUP BY 1)
SELECT schedule_key, CAST(row_number() OVER (ORDER BY started_at ASC NULLS FIRST, schedule_key) AS BIGINT) AS place FROM keys LEFT JOIN last USING (schedule_key) WHERE started_at IS NULL OR started_at <= TIMESTAMP '{lifecycle.AS_OF}' - INTERVAL 168 HOUR QUALIFY place <= 30""", "run"))
def schedule_queue(spark, sf_dir):
    """The next schedules to run: those that never ran first, then the longest waiting."""
    last = read(spark, sf_dir, "run").where("schedule_key IS NOT NULL").groupBy("schedule_key").agg(F.max("started_at").alias("started_at"))
    keys = read(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 45).cast("string")).alias("schedule_key")).distinct().join(last, "schedule_key", "left")
    due = keys.where(F.col("started_at").isNull() | (F.col("started_at") <= F.lit(lifecycle.AS_OF).cast("timestamp") - F.expr("INTERVAL 168 HOURS")))
    return picks.ranking(due, [F.col("started_at").asc_nulls_first(), F.asc("schedule_key")], 30, 1).select("schedule_key", F.col("rank").cast("bigint").alias("place"))


# Names of product types by language.
LABELS = {
    "en": {"chequing": "Chequing", "savings": "Savings", "gic": "GIC", "credit-card": "Credit Card", "mortgage": "Mortgage", "line-of-credit": "Line of Credit"},
    "ko": {"chequing": "입출금", "savings": "저축", "gic": "GIC", "credit-card": "신용카드", "mortgage": "모기지"},
    "ja": {"chequing": "当座預金", "savings": "貯蓄預金", "gic": "GIC", "credit-card": "クレジットカード", "mortgage": "住宅ローン"},
}
_ROWS = ", ".join(f"('{loc}', '{code}', '{label}')" for loc, own in LABELS.items() for code, label in own.items())


@query(sql(f"""
WITH l AS (SELECT * FROM (VALUES {_ROWS}) x(locale, code, label)), t AS (SELECT DISTINCT product_type AS code, unnest(['en', 'ko', 'ja', 'fr']) AS asked FROM product)
SELECT asked, t.code, coalesce(label, (SELECT string_agg(upper(w[1]) || w[2:], ' ') FROM (SELECT unnest(string_split(t.code, '-')) AS w))) AS label FROM t LEFT JOIN l ON l.code = t.code AND l.locale = CASE WHEN asked IN ('en', 'ko', 'ja') THEN asked ELSE 'en' END""", "product"))  # fmt: skip
def localized_types(spark, sf_dir):
    """Product types in the language asked for, English where that isn't known, the code in words where there is no label."""
    labels = F.create_map(*[F.lit(x) for loc, own in LABELS.items() for code, label in own.items() for x in (f"{loc}/{code}", label)])
    asked = F.explode(F.array(*map(F.lit, ("en", "ko", "ja", "fr")))).alias("asked")
    types = read(spark, sf_dir, "product").select(F.col("product_type").alias("code")).distinct().select("code", asked)
    locale = F.when(F.col("asked").isin(*LABELS), F.col("asked")).otherwise("en")
    return types.select("asked", "code", F.coalesce(F.try_element_at(labels, F.concat_ws("/", locale, "code")), tx.human(F.col("code"))).alias("label"))


@query(public.projected("""
, kept AS (SELECT * FROM active WHERE NOT (product_type IN ('savings', 'gic', 'mortgage') AND rate IS NULL))
SELECT CAST((SELECT count(*) FROM proj) AS BIGINT) AS projection_rows, CAST((SELECT count(*) FROM active) - (SELECT count(*) FROM kept) AS BIGINT) AS excluded_rows, CAST((SELECT count(*) FROM kept) AS BIGINT) AS active_rows, CAST((SELECT count(DISTINCT product_type) FROM kept) AS BIGINT) AS metric_scopes,
  CAST((SELECT count(*) FROM kept WHERE product_type = 'gic' AND rate IS NOT NULL AND term_length_days IS NOT NULL) AS BIGINT) AS scatter_rows"""))
def refresh_counts(spark, sf_dir):
    """How many rows a refresh projected, left out and used, in one pass."""
    active = F.col("status") == "active"
    out = active & F.col("product_type").isin("savings", "gic", "mortgage") & F.col("rate").isNull()
    scatter = active & ~out & (F.col("product_type") == "gic") & F.col("rate").isNotNull() & F.col("term_length_days").isNotNull()
    return public.rows(spark, sf_dir).agg(F.count("*").alias("projection_rows"), F.count_if(out).alias("excluded_rows"), F.count_if(active & ~out).alias("active_rows"), F.count_distinct(F.when(active & ~out, F.col("product_type"))).alias("metric_scopes"), F.count_if(scatter).alias("scatter_rows"))


@query(sql("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT run_id) AS BIGINT) AS n_runs, CAST(count(DISTINCT candidate_id) AS BIGINT) AS n_candidates, CAST(count(DISTINCT agent_name) AS BIGINT) AS n_agents, CAST(count(DISTINCT (provider_name, model_name)) AS BIGINT) AS n_models,
  round(CAST(sum(cost_micros) AS DOUBLE) / count(*), 6) AS cost_each, round(CAST(sum(cost_micros) AS DOUBLE) / sum(prompt_tokens + completion_tokens) * 1000, 6) AS cost_per_1k FROM usage""", "usage"))
def usage_summary(spark, sf_dir):
    tokens, cost = F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.sum("cost_micros").cast("double")
    return read(spark, sf_dir, "usage").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("candidate_id").alias("n_candidates"), F.count_distinct("agent_name").alias("n_agents"), F.count_distinct("provider_name", "model_name").alias("n_models"), F.round(cost / F.count("*"), 6).alias("cost_each"), F.round(F.when(tokens > 0, cost / tokens * 1000).otherwise(0.0), 6).alias("cost_per_1k"))


@query(sql("SELECT run_id, agent_name AS stage_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM usage WHERE run_id IN (SELECT run_id FROM run WHERE run_state = 'failed') GROUP BY 1, 2", "usage", "run"))
def usage_by_stage(spark, sf_dir):
    """Usage of each stage inside the runs that failed."""
    failed = read(spark, sf_dir, "run").where("run_state = 'failed'").select("run_id")
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return read(spark, sf_dir, "usage").join(failed, "run_id", "left_semi").groupBy("run_id", F.col("agent_name").alias("stage_name")).agg(F.count("*").alias("n"), total("prompt_tokens"), total("completion_tokens"), total("cost_micros"))


@query(sql("""
SELECT usage_id, CAST(prompt_tokens + completion_tokens AS BIGINT) AS tokens, 'info' AS signal FROM usage WHERE agent_name = 'view' ORDER BY tokens DESC, usage_id LIMIT 5""", "usage"))
def usage_highlights(spark, sf_dir):
    """Rows beyond a limit that none reaches here, so the five largest stand in, as information."""
    rows = read(spark, sf_dir, "usage").where("agent_name = 'view'").select("usage_id", (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("tokens"))
    return picks.or_top(rows, F.col("tokens") >= 1_000_000, [F.desc("tokens"), F.asc("usage_id")], 20, 5)


@query(sql("""
WITH s AS (SELECT product_id, version_no, rate_value, note, approved_at, lag(rate_value) OVER w AS old_rate, lag(note) OVER w AS old_note, lag(approved_at) OVER w AS old_at FROM version WINDOW w AS (PARTITION BY product_id ORDER BY version_no)),
d AS (SELECT *, [x for x in [CASE WHEN approved_at IS DISTINCT FROM old_at THEN 'Approved At' END, CASE WHEN note IS DISTINCT FROM old_note THEN 'Note: ' || old_note || ' -> ' || note END, CASE WHEN rate_value IS DISTINCT FROM old_rate THEN 'Rate Value' END] if x IS NOT NULL] AS parts FROM s WHERE version_no > 1)
SELECT product_id, CAST(version_no AS BIGINT) AS version_no, nullif(array_to_string(parts[1:2], '; ') || CASE WHEN len(parts) > 2 THEN ' (+' || (len(parts) - 2) || ' more)' ELSE '' END, '') AS summary FROM d""", "version"))  # fmt: skip
def change_summaries(spark, sf_dir):
    """What a version changed, the first two fields in words and how many more."""
    own = Window.partitionBy("product_id").orderBy("version_no")
    before = lambda c: F.lag(c).over(own)
    fields = {"approved_at": F.lit("Approved At"), "note": F.concat(F.lit("Note: "), F.col("old_note"), F.lit(" -> "), F.col("note")), "rate_value": F.lit("Rate Value")}
    steps = read(spark, sf_dir, "version").select("product_id", "version_no", *fields, *[before(c).alias(f"old_{c}") for c in fields]).where("version_no > 1")
    parts = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), words) for c, words in fields.items()]))
    return steps.withColumn("parts", parts).select("product_id", F.col("version_no").cast("bigint").alias("version_no"), state.shortened(F.col("parts"), 2).alias("summary"))
