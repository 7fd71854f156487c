"""Login attempts and the failures of their address before them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import sliding
from quarrystone.plans.registry import query
from quarrystone.sources.adapters import read, sql

#: Outcomes that count as failures, the seconds that are looked back, and failures from which on an address is held.
FAILED, SECONDS, HELD = ("failed", "rate_limited", "locked_out"), 6 * 3600, 20


def failed():
    return F.col("attempt_outcome").isin(*FAILED)


@query(sql(f"""
SELECT attempt_id, ip_address, CAST(n AS BIGINT) AS n_failures, n >= {HELD} AS held FROM (
  SELECT attempt_id, ip_address, CASE WHEN ip_address IS NULL THEN 0 ELSE count(*) FILTER (WHERE attempt_outcome IN {FAILED}) OVER (PARTITION BY ip_address ORDER BY attempted_at RANGE BETWEEN INTERVAL {SECONDS} SECOND PRECEDING AND CURRENT ROW) END AS n FROM login_attempt)""", "login_attempt"))  # fmt: skip
def recent_attempt_failures(spark, sf_dir):
    """At every attempt, how many of its address failed in the hours before, and whether the address is held for that."""
    found = sliding.preceding(read(spark, sf_dir, "login_attempt"), "ip_address", "attempted_at", failed(), SECONDS, "n_failures")
    return found.select("attempt_id", "ip_address", "n_failures", (F.col("n_failures") >= HELD).alias("held"))
