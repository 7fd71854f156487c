r"""Filters by tags and buckets, further sorts, fallbacks of rates and fields, supplements, events of upserts, keep-sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import rates
from quarrystone.functions import text as tx
from quarrystone.operators import picks, quality, state
from quarrystone.plans import lifecycle, public
from quarrystone.plans.rates import T
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import SORTED, read, sql, tasks


@query(public.projected("SELECT product_id, tags, fee_bucket, balance_bucket FROM active WHERE len(list_intersect(string_split(coalesce(tags, ''), ','), ['student', 'senior'])) > 0 AND fee_bucket = 'low' AND balance_bucket IN ('under_1000', '1000_to_5000') AND lower(country_code) IN ('ca', 'us')"))
def products_by_tags_and_buckets(spark, sf_dir):
    """Products under any of some tags and all of some buckets at once; codes in any case."""
    found = public.products(public.active(spark, sf_dir).withColumn("country", F.lower("country_code")), {"country": ["ca", "us"], "fee_bucket": ["low"], "balance_bucket": ["under_1000", "1000_to_5000"]}, tags=["student", "senior"])
    return found.select("product_id", "tags", "fee_bucket", "balance_bucket")


MORE_SORTS = {"balance_desc": "minimum_balance DESC NULLS LAST, product_id", "deposit_asc": "minimum_deposit ASC NULLS LAST, product_id", "term_asc": "term_length_days ASC NULLS LAST, product_id", "term_desc": "term_length_days DESC NULLS LAST, product_id", "name_desc": "product_name DESC, bank_name DESC, product_id DESC"}


@query(public.projected(" UNION ALL ".join(f"SELECT '{n}' AS sort, rank, product_id FROM (SELECT product_id, row_number() OVER (ORDER BY {o}) AS rank FROM active) WHERE rank <= 20" for n, o in MORE_SORTS.items())))
def further_product_sorts(spark, sf_dir):
    df, c, tie = public.active(spark, sf_dir), F.col, F.asc("product_id")
    orders = {"balance_desc": [c("minimum_balance").desc_nulls_last(), tie], "deposit_asc": [c("minimum_deposit").asc_nulls_last(), tie], "term_asc": [c("term_length_days").asc_nulls_last(), tie], "term_desc": [c("term_length_days").desc_nulls_last(), tie], "name_desc": [F.desc("product_name"), F.desc("bank_name"), F.desc("product_id")]}
    return reduce(DataFrame.unionByName, [picks.ranking(df, order, 20, 1).select(F.lit(name).alias("sort"), F.col("rank").cast("bigint").alias("rank"), "product_id") for name, order in orders.items()])


@query(sql("""
WITH t AS (SELECT product_id, max(rate_value) / 10 AS best FROM version WHERE version_no <= 24 GROUP BY 1)
SELECT product_id, CASE WHEN direct_rate IS NOT NULL THEN direct_rate WHEN posted_rate IS NOT NULL THEN posted_rate WHEN product_family <> 'lending' THEN CAST(best AS DOUBLE) END AS rate, CASE WHEN direct_rate IS NOT NULL THEN 'direct' WHEN posted_rate IS NOT NULL THEN CASE WHEN product_family = 'lending' THEN 'mortgage_rate' ELSE 'standard_rate' END WHEN product_family <> 'lending' AND best IS NOT NULL THEN 'term_table' END AS origin
FROM product LEFT JOIN t USING (product_id)""", "product", "version"))  # fmt: skip
def display_rates(spark, sf_dir):
    """The rate to show: the direct one, that of the family, or, for deposits, the best of the term table."""
    table = read(spark, sf_dir, "version").where("version_no <= 24").groupBy("product_id").agg((F.max("rate_value") / 10).cast("double").alias("best"))
    deposit = F.col("product_family") != "lending"
    df = read(spark, sf_dir, "product").join(table, "product_id", "left")
    origin = quality.first_match([(F.col("direct_rate").isNotNull(), "direct"), (F.col("posted_rate").isNotNull() & ~deposit, "mortgage_rate"), (F.col("posted_rate").isNotNull(), "standard_rate"), (deposit & F.col("best").isNotNull(), "term_table")])
    return df.select("product_id", F.coalesce("direct_rate", "posted_rate", F.when(deposit, F.col("best"))).alias("rate"), origin.alias("origin"))


@query(sql("""
WITH s AS (SELECT product_id, note, rate_value, row_number() OVER (PARTITION BY product_id, note ORDER BY version_no DESC) AS k FROM version), f AS (SELECT product_id, max(CASE WHEN note = 'R' THEN rate_value END) AS a, max(CASE WHEN note = 'A' THEN rate_value END) AS b, max(CASE WHEN note = 'N' AND rate_value < 45 THEN rate_value END) AS c FROM s WHERE k = 1 GROUP BY 1)
SELECT product_id, CAST(coalesce(posted_rate, a, b, c) AS DOUBLE) AS rate, CAST(coalesce(monthly_fee, b, c) AS DOUBLE) AS fee, CAST(coalesce(minimum_deposit, c) AS DOUBLE) AS deposit, concat_ws(',', CASE WHEN posted_rate IS NULL AND coalesce(a, b, c) IS NOT NULL THEN 'rate' END, CASE WHEN monthly_fee IS NULL AND coalesce(b, c) IS NOT NULL THEN 'fee' END, CASE WHEN minimum_deposit IS NULL AND c IS NOT NULL THEN 'deposit' END) AS supplemented FROM product LEFT JOIN f USING (product_id)""", "product", "version"))  # fmt: skip
def supporting_supplements(spark, sf_dir):
    """Gaps of several fields filled from supporting sources, each field by its own precedence of kinds, the newest of a kind, and only what is compatible."""
    newest = picks.latest_per_key(read(spark, sf_dir, "version"), ["product_id", "note"], [F.desc("version_no")])
    kind = lambda n, test=True: F.max(F.when((F.col("note") == n) & F.lit(test) if test is True else (F.col("note") == n) & test, F.col("rate_value")))
    support = newest.groupBy("product_id").agg(kind("R").alias("a"), kind("A").alias("b"), kind("N", F.col("rate_value") < 45).alias("c"))
    order = {"rate": ("posted_rate", ["a", "b", "c"]), "fee": ("monthly_fee", ["b", "c"]), "deposit": ("minimum_deposit", ["c"])}
    df = read(spark, sf_dir, "product").join(support, "product_id", "left")
    filled = [F.coalesce(own, *[F.col(c).cast("double") for c in others]).alias(name) for name, (own, others) in order.items()]
    marks = [F.when(F.col(own).isNull() & F.coalesce(*others).isNotNull(), name) for name, (own, others) in order.items()]
    return df.select("product_id", *filled, F.concat_ws(",", *marks).alias("supplemented"))


@query(sql(f"""
WITH o AS (SELECT product_id, display_rate, {T} AS t FROM offer), p AS (SELECT product_id, TRY_CAST(nullif(regexp_extract(t, '\\bpromotional\\s+rate\\s+(?:of\\s+)?([0-9]{{1,2}}(?:\\.[0-9]{{1,4}})?)\\s*%', 1), '') AS DOUBLE) AS promo, TRY_CAST(nullif(regexp_extract(t, 'interest rate\\D{{0,24}}([0-9]{{1,2}}(?:\\.[0-9]{{1,4}})?)\\s*%', 1), '') AS DOUBLE) AS labelled, TRY_CAST(nullif(regexp_extract(t, '(?:^|[^0-9.])([0-9]{{1,2}}(?:\\.[0-9]{{1,4}})?)\\s*%', 1), '') AS DOUBLE) AS bare, display_rate FROM o)
SELECT product_id, coalesce(promo, labelled, bare, display_rate) AS rate, CASE WHEN promo IS NOT NULL THEN 'promotional' WHEN labelled IS NOT NULL THEN 'labelled' WHEN bare IS NOT NULL THEN 'bare' WHEN display_rate IS NOT NULL THEN 'shown' END AS pass FROM p""", "offer"))  # fmt: skip
def fallback_rates(spark, sf_dir):
    """Passes over a text in fixed order; the first that finds a rate gives it."""
    t = rates.context(F.col("offer_text"))
    passes = {"promotional": r"\bpromotional\s+rate\s+(?:of\s+)?" + rates.RATE, "labelled": r"interest rate\D{0,24}" + rates.RATE, "bare": r"(?:^|[^0-9.])" + rates.RATE}
    found = {name: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("double") for name, p in passes.items()} | {"shown": F.col("display_rate")}
    return read(spark, sf_dir, "offer").select("product_id", F.coalesce(*found.values()).alias("rate"), quality.first_match([(v.isNotNull(), n) for n, v in found.items()]).alias("pass"))


@query(sql(f"SELECT product_id, CASE WHEN strpos(t, '%') > 0 THEN substr(t, greatest(strpos(t, '%') - 24, 1), strpos(t, '%') + 12 - greatest(strpos(t, '%') - 24, 1)) END AS around FROM (SELECT product_id, {T} AS t FROM offer)", "offer"))
def rate_contexts(spark, sf_dir):
    """The words around the first percentage of an offer."""
    t = rates.context(F.col("offer_text"))
    at = F.instr(t, "%")
    return read(spark, sf_dir, "offer").select("product_id", F.when(at > 0, tx.around(t, at, 24, 12)).alias("around"))


@query(sql("""
WITH p AS (SELECT product_id, product_type, CAST(version_no AS BIGINT) AS version_no, note, rate_value, lag(note) OVER w AS old_note, lag(rate_value) OVER w AS old_rate FROM version JOIN product USING (product_id) WINDOW w AS (PARTITION BY product_id ORDER BY version_no))
SELECT product_id, version_no, CASE WHEN old_note IS NULL THEN 'New' WHEN note = 'R' AND old_note <> 'R' THEN 'ManualOverride' WHEN note <> old_note THEN 'Reclassified' WHEN rate_value <> old_rate THEN 'Updated' ELSE 'Verified' END AS event_type FROM p""", "version", "product"))
def version_events(spark, sf_dir):
    """What each version did to its product: new, overridden by hand, reclassified, updated, or only verified again."""
    from pyspark.sql import Window

    own = Window.partitionBy("product_id").orderBy("version_no")
    versions = read(spark, sf_dir, "version").repartition(tasks(read(spark, sf_dir, "lineitem"), *SORTED), "product_id")
    steps = versions.join(read(spark, sf_dir, "product").select("product_id"), "product_id", "left_semi").withColumn("old_note", F.lag("note").over(own)).withColumn("old_rate", F.lag("rate_value").over(own))
    rules = [(F.col("old_note").isNull(), "New"), ((F.col("note") == "R") & (F.col("old_note") != "R"), "ManualOverride"), (F.col("note") != F.col("old_note"), "Reclassified"), (F.col("rate_value") != F.col("old_rate"), "Updated")]
    return steps.select("product_id", F.col("version_no").cast("bigint").alias("version_no"), quality.first_match(rules, "Verified").alias("event_type"))


@query(sql("""
WITH e AS (SELECT product_id AS explicit, 'T' || substr(product_id, 2) AS task_id FROM product WHERE product_id LIKE '%7'), v AS (SELECT 'V' || split_part(substr(version_id, 2), '-', 1) AS key, min(product_id) AS evidence FROM version GROUP BY 1 HAVING count(DISTINCT product_id) = 1),
n AS (SELECT regexp_replace(lower(product_name), '[^a-z0-9]', '', 'g') AS name, min(product_id) AS named FROM product GROUP BY 1 HAVING count(*) = 1)
SELECT task_id, coalesce(explicit, evidence, named) AS product_id, CASE WHEN explicit IS NOT NULL THEN 'explicit' WHEN evidence IS NOT NULL THEN 'evidence' ELSE 'name' END AS matched_by FROM task LEFT JOIN e USING (task_id) LEFT JOIN v ON v.key = 'V' || substr(task_id, 2) LEFT JOIN n ON n.name = regexp_replace(lower(task.product_name), '[^a-z0-9]', '', 'g') WHERE coalesce(explicit, evidence, named) IS NOT NULL""", "task", "product", "version"))  # fmt: skip
def matched_current_products(spark, sf_dir):
    """The product that a task is about: by explicit id, else by evidence of one product alone, else by a name that one alone has."""
    product, task = read(spark, sf_dir, "product"), read(spark, sf_dir, "task")
    explicit = product.where("product_id LIKE '%7'").select(F.col("product_id").alias("explicit"), F.concat(F.lit("T"), F.substring("product_id", 2, 40)).alias("task_id"))
    evidence = read(spark, sf_dir, "version").groupBy(F.concat(F.lit("T"), F.substring_index(F.substring("version_id", 2, 40), "-", 1)).alias("task_id")).agg(F.min("product_id").alias("evidence"), F.max("product_id").alias("last")).where("evidence = last").select("task_id", "evidence")
    named = product.groupBy(tx.identity(F.col("product_name")).alias("name")).agg(F.min("product_id").alias("named"), F.count("*").alias("n")).where("n = 1").select("name", "named")
    joined = task.join(explicit, "task_id", "left").join(evidence, "task_id", "left").join(named, tx.identity(F.col("product_name")) == F.col("name"), "left")
    return joined.select("task_id", F.coalesce("explicit", "evidence", "named").alias("product_id"), quality.first_match([(F.col("explicit").isNotNull(), "explicit"), (F.col("evidence").isNotNull(), "evidence")], "name").alias("matched_by")).where("product_id IS NOT NULL")


@query(sql(f"""
WITH active AS (SELECT run_id FROM run WHERE run_state = 'started' OR started_at >= TIMESTAMP '{lifecycle.AS_OF}' - INTERVAL 14 DAY), linked AS (SELECT DISTINCT run_id FROM task WHERE review_state IN ('queued', 'approved')),
last AS (SELECT run_id FROM (SELECT run_id, row_number() OVER (PARTITION BY schedule_key ORDER BY started_at DESC, run_id DESC) AS k FROM run WHERE schedule_key IS NOT NULL) WHERE k = 1)
SELECT CAST((SELECT count(*) FROM run) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_kept, CAST((SELECT count(*) FROM run) - count(*) AS BIGINT) AS n_removed FROM run WHERE run_id IN (SELECT * FROM active UNION SELECT * FROM linked UNION SELECT * FROM last)""", "run", "task"))  # fmt: skip
def kept_runs(spark, sf_dir):
    """How many runs stay: active or recent ones, those that open or approved work links to, and the last of each schedule."""
    run = read(spark, sf_dir, "run")
    recent = F.col("started_at") >= F.lit(lifecycle.AS_OF).cast("timestamp") - F.expr("INTERVAL 14 DAYS")
    keep = run.where((F.col("run_state") == "started") | recent).select("run_id").union(read(spark, sf_dir, "task").where("review_state IN ('queued', 'approved')").select("run_id"))
    keep = keep.union(picks.latest_per_key(run.where("schedule_key IS NOT NULL"), ["schedule_key"], [F.desc("started_at"), F.desc("run_id")]).select("run_id")).distinct().withColumn("kept", F.lit(1))
    return run.select("run_id").join(keep, "run_id", "left").agg(F.count("*").alias("n"), F.count("kept").alias("n_kept"), (F.count("*") - F.count("kept")).alias("n_removed"))


@query("""
WITH d AS (SELECT doc_id, source, sha256('text/plain' || chr(10) || coalesce(text, '')) AS fingerprint FROM documents), known AS (SELECT DISTINCT source, fingerprint FROM d WHERE doc_id % 3 = 0)
SELECT doc_id, source, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY source, fingerprint ORDER BY doc_id) AS k FROM d WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM known WHERE known.source IS NOT DISTINCT FROM d.source AND known.fingerprint = d.fingerprint)) WHERE k = 1""")
def new_snapshots(spark, sf_dir):
    """Captures whose content their source hasn't had before, each once: an anti-join with what was parsed already."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.concat_ws("\n", F.lit("text/plain"), F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))
    known = docs.where("doc_id % 3 = 0").select(F.col("source").alias("s"), F.col("fingerprint").alias("f")).distinct()
    fresh = docs.where("doc_id % 3 <> 0").join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("fingerprint") == F.col("f")), "left_anti")
    return fresh.groupBy("source", "fingerprint").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", "fingerprint")


@query(sql("""
WITH u AS (SELECT task_id, product_name, bank_code, product_type, created_at, bank_code || '/' || confidence AS url, count(*) OVER (PARTITION BY bank_code || '/' || confidence) AS n FROM task WHERE review_state IN ('queued', 'deferred')),
a AS (SELECT task_id, first_value(task_id) OVER (PARTITION BY product_name, bank_code, product_type ORDER BY created_at DESC, task_id DESC) AS by_name FROM u), b AS (SELECT task_id, first_value(task_id) OVER (PARTITION BY url ORDER BY created_at DESC, task_id DESC) AS by_url FROM u WHERE n <= 2 AND url IS NOT NULL)
SELECT task_id, CASE WHEN by_name <> task_id THEN by_name ELSE by_url END AS superseded_by, CASE WHEN by_name <> task_id THEN 'name' ELSE 'url' END AS rule FROM a LEFT JOIN b USING (task_id) WHERE by_name <> task_id OR by_url <> task_id""", "task"))  # fmt: skip
def superseded_by_name_or_url(spark, sf_dir):
    """Open tasks that a newer one replaces: of the same logical product, else of a URL that no more than two share."""
    tasks = read(spark, sf_dir, "task").where("review_state IN ('queued', 'deferred')").withColumn("url", F.concat("bank_code", F.lit("/"), "confidence"))
    order = [F.desc("created_at"), F.desc("task_id")]
    by_name = state.superseded(tasks, ["product_name", "bank_code", "product_type"], order, "task_id").select("task_id", F.col("superseded_by").alias("by_name"))
    few = tasks.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n")).where("n <= 2").select("url")
    by_url = state.superseded(tasks.join(few, "url", "left_semi"), ["url"], order, "task_id").select("task_id", F.col("superseded_by").alias("by_url"))
    return by_name.join(by_url, "task_id", "full").select("task_id", F.coalesce("by_name", "by_url").alias("superseded_by"), F.when(F.col("by_name").isNotNull(), "name").otherwise("url").alias("rule"))
