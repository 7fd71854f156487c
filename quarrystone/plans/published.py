"""The snapshot that the public reads: built, written by executors, and read by the dashboard through its pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrystone.operators import lineage
from quarrystone.plans import public
from quarrystone.plans.registry import query
from quarrystone.sources import publish

_SNAPSHOT = """
, lacks AS (SELECT *, (product_type IN ('savings', 'gic', 'mortgage', 'credit-card', 'personal-loan') AND rate IS NULL) OR (product_type = 'chequing' AND fee IS NULL) OR (product_type = 'gic' AND (term_length_days IS NULL OR minimum_deposit IS NULL)) OR coalesce(product_type = 'chequing' AND fee > 0 AND minimum_balance IS NULL, false) AS lacking FROM proj),
snap AS (SELECT * FROM lacks WHERE status = 'active' AND NOT lacking)
"""


def snapshot(spark, sf_dir):
    """Active rows that comparisons can use, of all countries."""
    fit = public.snapshot_build(spark, sf_dir).where("in_snapshot").select("product_id")
    return public.active(spark, sf_dir).join(fit, "product_id", "left_semi")


@query(public.projected(_SNAPSHOT + "SELECT country_code, product_type, CAST(count(*) AS BIGINT) AS n_products, max(rate) AS max_rate, round(avg(fee), 6) AS mean_fee, max(last_changed_on) AS change_cutoff, true AS written, false AS written_again, CAST((SELECT count(*) FROM snap WHERE country_code = 'CA') AS BIGINT) AS n_before FROM snap GROUP BY 1, 2"))
def published_dashboard(spark, sf_dir):
    """The dashboard's figures of each country and type, from what is published; also whether the files were new, the first time and again."""
    root = f"{lineage.shared_folder(spark)}/public-{uuid.uuid4().hex}"
    rows = snapshot(spark, sf_dir)
    publish.publish(rows.where("country_code = 'CA'"), root)
    first, again = publish.publish(rows, root), publish.publish(rows.orderBy("product_id"), root)
    before = publish.published(spark, root, back=1).count()
    served = publish.published(spark, root).groupBy("country_code", "product_type").agg(F.count("*").alias("n_products"), F.max("rate").alias("max_rate"), F.round(F.avg("fee"), 6).alias("mean_fee"), F.max("last_changed_on").alias("change_cutoff"))
    return served.withColumn("written", F.lit(first["written"])).withColumn("written_again", F.lit(again["written"])).withColumn("n_before", F.lit(before).cast("bigint"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CAST((SELECT count(DISTINCT text) + max(CAST(text IS NULL AND NOT EXISTS (SELECT 1 FROM documents WHERE text = '') AS INTEGER)) FROM documents) AS BIGINT) AS n_stored FROM documents")
def stored_objects(spark, sf_dir):
    """Bodies of documents put in a store by content, half of them twice, and found again by their digests."""
    from quarrystone.sources.adapters import read

    store = f"{lineage.shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    objects = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    publish.put(objects.where("key % 2 = 0"), store)
    index = publish.put(objects, store)
    n = publish.stored(spark, store).count()
    found = publish.get(spark, store, index).where(F.sha2("body", 256) == F.col("digest"))
    return found.select(F.col("key").alias("doc_id"), "digest", "size", F.lit(n).cast("bigint").alias("n_stored"))
