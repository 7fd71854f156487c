"""Public catalogue: projection, products, facets, countries, dashboard, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators import picks
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

#: Day that the adapters' snapshot was refreshed on.
ANCHOR = "2026-04-13"
FEE_BINS = ([(0, "free"), (15, "low")], "high")
BALANCE_BINS = ([(0, "none"), (1000, "under_1000"), (5000, "1000_to_5000")], "5000_plus")
DEPOSIT_BINS = ([(0, "none"), (500, "under_500"), (5000, "500_to_5000")], "5000_plus")


def projection(product: DataFrame) -> DataFrame:
    """Public rows: display rate and fee by fallback, and four bins. Blank tags become no tags."""
    term = F.col("term_length_days")
    return product.select(
        "product_id", "bank_code", "bank_name", "country_code", "product_family", "product_type", "subtype_code", "product_name", "status",
        F.coalesce("direct_rate", "posted_rate").alias("rate"), F.coalesce("display_fee", "monthly_fee").alias("fee"), "minimum_balance", "minimum_deposit", "term_length_days",
        F.nullif(F.col("tags"), F.lit("")).alias("tags"), "last_changed_on",
        picks.binned(F.coalesce("display_fee", "monthly_fee"), *FEE_BINS).alias("fee_bucket"),
        picks.binned(F.col("minimum_balance"), *BALANCE_BINS).alias("balance_bucket"),
        picks.binned(F.col("minimum_deposit"), *DEPOSIT_BINS).alias("deposit_bucket"),
        F.when(term < 365, "under_1y").when(term <= 1095, "from_1y_to_3y").when(term.isNotNull(), "over_3y").alias("term_bucket"),
    )


PROJECTED = """
proj AS (SELECT product_id, bank_code, bank_name, country_code, product_family, product_type, subtype_code, product_name, status, coalesce(direct_rate, posted_rate) AS rate,
  coalesce(display_fee, monthly_fee) AS fee, minimum_balance, minimum_deposit, term_length_days, CASE WHEN tags = '' THEN NULL ELSE tags END AS tags, last_changed_on,
  CASE WHEN coalesce(display_fee, monthly_fee) IS NULL THEN NULL WHEN coalesce(display_fee, monthly_fee) <= 0 THEN 'free' WHEN coalesce(display_fee, monthly_fee) < 15 THEN 'low' ELSE 'high' END AS fee_bucket,
  CASE WHEN minimum_balance IS NULL THEN NULL WHEN minimum_balance <= 0 THEN 'none' WHEN minimum_balance < 1000 THEN 'under_1000' WHEN minimum_balance < 5000 THEN '1000_to_5000' ELSE '5000_plus' END AS balance_bucket,
  CASE WHEN minimum_deposit IS NULL THEN NULL WHEN minimum_deposit <= 0 THEN 'none' WHEN minimum_deposit < 500 THEN 'under_500' WHEN minimum_deposit < 5000 THEN '500_to_5000' ELSE '5000_plus' END AS deposit_bucket,
  CASE WHEN term_length_days IS NULL THEN NULL WHEN term_length_days < 365 THEN 'under_1y' WHEN term_length_days <= 1095 THEN 'from_1y_to_3y' ELSE 'over_3y' END AS term_bucket
  FROM product),
active AS (SELECT * FROM proj WHERE status = 'active')
"""


def projected(text: str) -> str:
    return sql(f"WITH {PROJECTED}{text}", "product")


def rows(spark, sf_dir) -> DataFrame:
    return projection(read(spark, sf_dir, "product"))


def active(spark, sf_dir) -> DataFrame:
    return rows(spark, sf_dir).where("status = 'active'")


@query(projected("SELECT * FROM proj"))
def public_projection(spark, sf_dir):
    return rows(spark, sf_dir)


def products(df: DataFrame, filters: dict[str, list] | None = None, needle: str = "", tags: list[str] | None = None) -> DataFrame:
    """Rows under all filters at once: lists of values, any of some tags, and a literal search in bank and product names."""
    df = picks.optional(df, filters or {})
    if tags:
        df = df.where(F.arrays_overlap(F.split(F.coalesce("tags", F.lit("")), ","), F.array(*map(F.lit, tags))))
    return picks.searched(df, needle, ["bank_name", "product_name"]) if needle else df


@query(projected("""
, wanted AS (SELECT * FROM active WHERE country_code IN ('CA', 'US', 'GB') AND product_type IN ('savings', 'gic', 'chequing') AND (contains(lower(product_name), 'r') OR contains(lower(bank_name), 'r')))
SELECT product_id, bank_name, product_type, rate, fee, total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages, 1 < ceil(total / 20.0) AS has_next
FROM (SELECT *, count(*) OVER () AS total FROM wanted) ORDER BY rate DESC NULLS LAST, product_id LIMIT 20"""))  # fmt: skip
def public_products_page(spark, sf_dir):
    found = products(active(spark, sf_dir), {"country_code": ["CA", "US", "GB"], "product_type": ["savings", "gic", "chequing"], "bank_code": []}, needle=" R ")
    return picks.page(found, [F.col("rate").desc_nulls_last(), F.col("product_id").asc()]).select("product_id", "bank_name", "product_type", "rate", "fee", "total", "total_pages", "has_next")


def orders_by_name() -> dict[str, list[Column]]:
    """The catalogue's sorts. Missing numbers come last either way; ties go by product_id."""
    c = F.col
    tie = c("product_id").asc()
    return {
        "default": [c("bank_name").asc(), c("product_type").asc(), c("product_name").asc(), tie],
        "rate_desc": [c("rate").desc_nulls_last(), tie],
        "rate_asc": [c("rate").asc_nulls_last(), tie],
        "fee_asc": [c("fee").asc_nulls_last(), tie],
        "fee_desc": [c("fee").desc_nulls_last(), tie],
        "balance_asc": [c("minimum_balance").asc_nulls_last(), tie],
        "deposit_desc": [c("minimum_deposit").desc_nulls_last(), tie],
        "bank_desc": [c("bank_name").desc(), c("product_type").desc(), c("product_name").desc(), c("product_id").desc()],
        "changed_desc": [c("last_changed_on").desc_nulls_last(), c("product_id").desc()],
    }


SORTS = {
    "default": "bank_name, product_type, product_name, product_id", "rate_desc": "rate DESC NULLS LAST, product_id", "rate_asc": "rate ASC NULLS LAST, product_id", "fee_asc": "fee ASC NULLS LAST, product_id",
    "fee_desc": "fee DESC NULLS LAST, product_id", "balance_asc": "minimum_balance ASC NULLS LAST, product_id", "deposit_desc": "minimum_deposit DESC NULLS LAST, product_id",
    "bank_desc": "bank_name DESC, product_type DESC, product_name DESC, product_id DESC", "changed_desc": "last_changed_on DESC NULLS LAST, product_id DESC",
}


@query(projected("".join((" UNION ALL " if i else " ") + f"SELECT '{n}' AS sort, rank, product_id FROM (SELECT product_id, row_number() OVER (ORDER BY {o}) AS rank FROM active) WHERE rank <= 20" for i, (n, o) in enumerate(SORTS.items()))))
def public_product_sorts(spark, sf_dir):
    df = active(spark, sf_dir)
    return reduce(DataFrame.unionByName, [picks.ranking(df, order, 20, 1).select(F.lit(name).alias("sort"), F.col("rank").cast("bigint").alias("rank"), "product_id") for name, order in orders_by_name().items()])


@query(projected("SELECT product_id, bank_name, product_type, rate FROM proj WHERE product_id = 'P42' AND country_code = (SELECT country_code FROM proj WHERE product_id = 'P42')"))
def public_product_by_id(spark, sf_dir):
    return rows(spark, sf_dir).where("product_id = 'P42'").select("product_id", "bank_name", "product_type", "rate")


@query(projected("""
SELECT facet, code, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'bank' AS facet, bank_code AS code FROM active UNION ALL SELECT 'type', product_type FROM active UNION ALL SELECT 'subtype', product_type || '/' || subtype_code FROM active
  UNION ALL SELECT 'tag', unnest(string_split(tags, ',')) FROM active UNION ALL SELECT 'fee', fee_bucket FROM active UNION ALL SELECT 'balance', balance_bucket FROM active
  UNION ALL SELECT 'deposit', deposit_bucket FROM active UNION ALL SELECT 'term', term_bucket FROM active)
WHERE code IS NOT NULL AND code <> '' GROUP BY facet, code"""))
def public_facets(spark, sf_dir):
    """All facets in one pass: each row becomes one (facet, code) per facet, then one count."""
    pair = lambda name, value: F.array(F.struct(F.lit(name).alias("facet"), value.alias("code")))
    tags = F.transform(F.split("tags", ","), lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("code")))
    codes = {"bank": "bank_code", "type": "product_type", "fee": "fee_bucket", "balance": "balance_bucket", "deposit": "deposit_bucket", "term": "term_bucket"}
    each = F.concat(*[pair(n, F.col(c)) for n, c in codes.items()], pair("subtype", F.concat("product_type", F.lit("/"), "subtype_code")), F.coalesce(tags, F.slice(pair("tag", F.lit("")), 1, 1)))
    return active(spark, sf_dir).select(F.inline(each)).where("code <> ''").groupBy("facet", "code").agg(F.count("*").alias("n"))


@query(sql("""
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY refreshed_at DESC, snapshot_id DESC) AS k FROM refresh WHERE refresh_status = 'completed' AND refresh_scope = 'public') WHERE k = 1)
SELECT last.country_code, last.snapshot_id, CAST(count(product_id) AS BIGINT) AS n_products FROM last LEFT JOIN product ON product.country_code = last.country_code AND product.status = 'active' GROUP BY 1, 2""", "refresh", "product"))  # fmt: skip
def public_countries(spark, sf_dir):
    last = picks.latest_per_key(read(spark, sf_dir, "refresh").where("refresh_status = 'completed' AND refresh_scope = 'public'"), ["country_code"], [F.col("refreshed_at").desc(), F.col("snapshot_id").desc()])
    counts = active(spark, sf_dir).groupBy("country_code").agg(F.count("*").alias("n"))
    return last.join(counts, "country_code", "left").select("country_code", "snapshot_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_products"))


@query(projected(f"""
SELECT CAST(count(*) AS BIGINT) AS n_products, CAST(count(DISTINCT bank_code) AS BIGINT) AS n_banks, max(rate) AS max_rate,
  CAST(count(*) FILTER (WHERE last_changed_on BETWEEN DATE '{ANCHOR}' - 30 AND DATE '{ANCHOR}') AS BIGINT) AS n_recent, CAST(count(*) FILTER (WHERE rate IS NULL) AS BIGINT) AS n_without_rate,
  max(last_changed_on) AS change_cutoff FROM active"""))  # fmt: skip
def dashboard_summary(spark, sf_dir):
    recent = picks.changed_since(None, "last_changed_on", ANCHOR)
    return active(spark, sf_dir).agg(F.count("*").alias("n_products"), F.count_distinct("bank_code").alias("n_banks"), F.max("rate").alias("max_rate"), F.count_if(recent).alias("n_recent"), F.count_if(F.col("rate").isNull()).alias("n_without_rate"), F.max("last_changed_on").alias("change_cutoff"))


@query(projected("""
SELECT breakdown, code, CAST(n AS BIGINT) AS n, round_even(n * 100.0 / total, 2) AS share_percent FROM (
  SELECT *, sum(n) OVER (PARTITION BY breakdown) AS total FROM (
    SELECT 'type' AS breakdown, product_type AS code, count(*) AS n FROM active GROUP BY 2 UNION ALL SELECT 'bank', bank_code, count(*) FROM active GROUP BY 2))"""))
def dashboard_composition(spark, sf_dir):
    df = active(spark, sf_dir)
    parts = [picks.breakdown(df, column).select(F.lit(name).alias("breakdown"), "code", "n", "share_percent") for name, column in (("type", "product_type"), ("bank", "bank_code"))]
    return parts[0].unionByName(parts[1])


@query(projected("""
, ranked AS (
  SELECT 'highest_rate' AS ranking, product_id, rate AS value, row_number() OVER (ORDER BY rate DESC, product_id) AS rank, count(*) OVER () AS n FROM active WHERE product_type = 'gic' AND rate IS NOT NULL
  UNION ALL SELECT 'lowest_fee', product_id, fee, row_number() OVER (ORDER BY fee, product_id), count(*) OVER () FROM active WHERE product_type = 'chequing' AND fee IS NOT NULL
  UNION ALL SELECT 'lowest_deposit', product_id, minimum_deposit, row_number() OVER (ORDER BY minimum_deposit, product_id), count(*) OVER () FROM active WHERE product_type = 'savings' AND minimum_deposit IS NOT NULL)
SELECT ranking, CAST(rank AS BIGINT) AS rank, product_id, value FROM ranked WHERE n >= 3 AND rank <= 5"""))  # fmt: skip
def dashboard_rankings(spark, sf_dir):
    df = active(spark, sf_dir)
    specs = [("highest_rate", "gic", "rate", F.desc), ("lowest_fee", "chequing", "fee", F.asc), ("lowest_deposit", "savings", "minimum_deposit", F.asc)]
    parts = [picks.ranking(df.where((F.col("product_type") == kind) & F.col(value).isNotNull()), [way(value), F.asc("product_id")]).select(F.lit(name).alias("ranking"), F.col("rank").cast("bigint").alias("rank"), "product_id", F.col(value).alias("value")) for name, kind, value, way in specs]
    return reduce(DataFrame.unionByName, parts)


@query(projected("""
, points AS (SELECT product_type, product_id, minimum_balance AS x, rate AS y, count(*) OVER (PARTITION BY product_type) AS n FROM active WHERE product_type IN ('chequing', 'savings') AND minimum_balance IS NOT NULL AND rate IS NOT NULL
  UNION ALL SELECT product_type, product_id, CAST(term_length_days AS DOUBLE), rate, count(*) OVER () FROM active WHERE product_type = 'gic' AND term_length_days IS NOT NULL AND rate IS NOT NULL)
SELECT product_type, product_id, x, y FROM points WHERE n >= 3"""))
def dashboard_scatter(spark, sf_dir):
    """Points of each type on the axes that its type asks for; a type with fewer than three has none."""
    axes = F.when(F.col("product_type") == "gic", F.col("term_length_days").cast("double")).when(F.col("product_type").isin("chequing", "savings"), F.col("minimum_balance"))
    points = active(spark, sf_dir).withColumn("x", axes).where("x IS NOT NULL AND rate IS NOT NULL")
    enough = points.groupBy("product_type").agg(F.count("*").alias("n")).where("n >= 3").select("product_type")
    return points.join(enough, "product_type", "left_semi").select("product_type", "product_id", "x", F.col("rate").alias("y"))


@query(projected("""
, lacks AS (SELECT product_id, product_type, status,
  CASE WHEN product_type IN ('savings', 'gic', 'mortgage', 'credit-card', 'personal-loan') AND rate IS NULL THEN 'rate' END AS m1, CASE WHEN product_type = 'chequing' AND fee IS NULL THEN 'fee' END AS m2,
  CASE WHEN product_type = 'gic' AND (term_length_days IS NULL OR minimum_deposit IS NULL) THEN 'term' END AS m3, CASE WHEN product_type = 'chequing' AND fee > 0 AND minimum_balance IS NULL THEN 'balance' END AS m4 FROM proj)
SELECT product_id, concat_ws(',', m1, m2, m3, m4) AS missing, concat_ws(',', m1, m2, m3, m4) = '' AS complete, status <> 'active' OR concat_ws(',', m1, m2, m3, m4) = '' AS in_snapshot FROM lacks"""))  # fmt: skip
def snapshot_build(spark, sf_dir):
    """Comparison requirements by product type, one of them conditional on a positive fee; active rows that lack one stay out of the snapshot."""
    kind = F.col("product_type")
    missing = F.concat_ws(
        ",",
        F.when(kind.isin("savings", "gic", "mortgage", "credit-card", "personal-loan") & F.col("rate").isNull(), "rate"),
        F.when((kind == "chequing") & F.col("fee").isNull(), "fee"),
        F.when((kind == "gic") & (F.col("term_length_days").isNull() | F.col("minimum_deposit").isNull()), "term"),
        F.when((kind == "chequing") & (F.col("fee") > 0) & F.col("minimum_balance").isNull(), "balance"),
    )
    return rows(spark, sf_dir).withColumn("missing", missing).select("product_id", "missing", (F.col("missing") == "").alias("complete"), ((F.col("status") != "active") | (F.col("missing") == "")).alias("in_snapshot"))


FRESH = """
WITH done AS (SELECT country_code, max(refreshed_at) AS served_at FROM refresh WHERE refresh_scope = 'public' AND refresh_status = 'completed' GROUP BY 1),
tried AS (SELECT country_code, max(attempted_at) AS failed_at FROM refresh WHERE refresh_scope = 'public' AND refresh_status = 'failed' GROUP BY 1),
open AS (SELECT country_code, count(*) AS pending FROM refresh WHERE refresh_scope = 'public' AND refresh_status = 'started' AND attempted_at >= TIMESTAMP '2001-06-01' GROUP BY 1)
"""


def attempts(spark, sf_dir) -> DataFrame:
    """Per country: when the served snapshot was made, the last failure, and attempts still pending."""
    status, public = F.col("refresh_status"), read(spark, sf_dir, "refresh").where("refresh_scope = 'public'")
    return public.groupBy("country_code").agg(F.max(F.when(status == "completed", F.col("refreshed_at"))).alias("served_at"), F.max(F.when(status == "failed", F.col("attempted_at"))).alias("failed_at"), F.count_if((status == "started") & (F.col("attempted_at") >= F.lit("2001-06-01").cast("timestamp"))).alias("pending"))


@query(sql(FRESH + "SELECT country_code, served_at, CASE WHEN failed_at > served_at THEN 'stale' ELSE 'fresh' END AS freshness FROM done LEFT JOIN tried USING (country_code)", "refresh"))
def freshness_status(spark, sf_dir):
    return attempts(spark, sf_dir).where("served_at IS NOT NULL").select("country_code", "served_at", F.when(F.col("failed_at") > F.col("served_at"), "stale").otherwise("fresh").alias("freshness"))


@query(sql(FRESH + """
, product_counts AS (SELECT country_code, count(*) AS canonical, count(*) FILTER (WHERE status = 'active') AS projected FROM product GROUP BY 1)
SELECT country_code, CASE WHEN coalesce(pending, 0) > 0 THEN 'pending' WHEN failed_at > served_at THEN 'failed' WHEN served_at < TIMESTAMP '2001-01-01' THEN 'stale' WHEN coalesce(projected, 0) = 0 THEN 'empty' ELSE 'healthy' END AS health,
  CASE WHEN coalesce(canonical, 0) = 0 THEN 0.0 ELSE round(CAST(greatest(canonical - projected, 0) AS DOUBLE) / canonical, 4) END AS missing_ratio
FROM done LEFT JOIN tried USING (country_code) LEFT JOIN open USING (country_code) LEFT JOIN product_counts USING (country_code)""", "refresh", "product"))  # fmt: skip
def dashboard_health(spark, sf_dir):
    counts = rows(spark, sf_dir).groupBy("country_code").agg(F.count("*").alias("canonical"), F.count_if(F.col("status") == "active").alias("projected"))
    joined = attempts(spark, sf_dir).where("served_at IS NOT NULL").join(counts, "country_code", "left")
    state = F.when(F.col("pending") > 0, "pending").when(F.col("failed_at") > F.col("served_at"), "failed").when(F.col("served_at") < F.lit("2001-01-01").cast("timestamp"), "stale").when(F.coalesce("projected", F.lit(0)) == 0, "empty").otherwise("healthy")
    ratio = F.when(F.coalesce("canonical", F.lit(0)) == 0, 0.0).otherwise(F.round(F.greatest(F.col("canonical") - F.col("projected"), F.lit(0)).cast("double") / F.col("canonical"), 4))
    return joined.select("country_code", state.alias("health"), ratio.alias("missing_ratio"))


@query(sql("""
WITH links AS (SELECT product_id, version_id AS source, 1 AS priority, version_no FROM version WHERE note = 'R' UNION ALL SELECT product_id, version_id, 2, version_no FROM version WHERE note = 'A'),
best AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY priority, version_no DESC, source) AS k FROM links)
SELECT product.product_id, best.source, best.priority FROM product LEFT JOIN best ON best.product_id = product.product_id AND k = 1""", "product", "version"))  # fmt: skip
def product_sources(spark, sf_dir):
    """The source to show for each product: reviewed links before others, the newest first."""
    links = read(spark, sf_dir, "version").where("note IN ('R', 'A')").select("product_id", F.col("version_id").alias("source"), F.when(F.col("note") == "R", 1).otherwise(2).alias("priority"), "version_no")
    best = picks.latest_per_key(links, ["product_id"], [F.asc("priority"), F.desc("version_no"), F.asc("source")])
    return rows(spark, sf_dir).select("product_id").join(best.drop("version_no"), "product_id", "left")
