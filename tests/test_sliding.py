"""Counts over the time before each row: brute force, batch and stream."""

import datetime
import random

from pyspark.sql import functions as F

from quarrystone.operators import sliding
from quarrystone.streaming import failures

START = datetime.datetime(2026, 1, 1)


def rows(n=300, hot=0.5):
    rng = random.Random(11)
    out = []
    for k in range(n):
        at = START + datetime.timedelta(seconds=rng.choice([rng.randrange(5000), 60 * rng.randrange(80)]))
        out.append((k, "hot" if rng.random() < hot else rng.choice(["a", "b", None]), None if k % 41 == 0 else at, rng.choice(["failed", "success", None])))
    return out


def brute(given, seconds):
    want = {}
    for i, key, at, _ in given:
        own = [t for _, k, t, o in given if k == key and t is not None and o == "failed"] if key and at else []
        want[i] = sum(at - datetime.timedelta(seconds=seconds) <= t <= at for t in own)
    return want


def test_counts_are_those_of_brute_force(spark):
    given = rows()
    df = spark.createDataFrame(given, "attempt_id long, ip string, at timestamp, outcome string").withColumn("_extra", F.lit(1))
    for seconds in (1, 60, 900, 100_000):
        got = sliding.preceding(df, "ip", "at", F.col("outcome") == "failed", seconds)
        assert got.columns == [*df.columns, "n_before"]
        assert {r.attempt_id: r.n_before for r in got.collect()} == brute(given, seconds)
    assert sliding.preceding(df.limit(0), "ip", "at", F.col("outcome") == "failed", 60).count() == 0


def test_a_hot_address_is_many_groups(spark):
    df = spark.createDataFrame([(k, "hot", START + datetime.timedelta(seconds=k), "failed") for k in range(1000)], "attempt_id long, ip string, at timestamp, outcome string")
    found = sliding.preceding(df, "ip", "at", F.col("outcome") == "failed", 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ip" in plan and "_period" in plan
    assert found.where("n_before = 51").count() == 950


def test_a_stream_in_order_tells_what_a_batch_tells(spark, tmp_path):
    given = sorted((r for r in rows(120) if r[1] and r[2]), key=lambda r: r[2])
    # attempts of one time arrive together
    cuts = [0, *sorted({next(j for j in range(k, len(given) + 1) if j == len(given) or given[j][2] != given[j - 1][2]) for k in (30, 70)}), len(given)]
    schema = "attempt_id long, key string, at timestamp, outcome string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(given[a:b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = failures.preceding(stream, F.col("outcome") == "failed", 900).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == b, n
    got = {r.attempt_id: r.n_before for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == brute(given, 900)


def test_no_row_is_counted_again_for_each_that_looks_back(spark):
    df = spark.createDataFrame([(k, "hot", START + datetime.timedelta(seconds=k // 50), "failed") for k in range(500)], "attempt_id long, ip string, at timestamp, outcome string")
    found = sliding.preceding(df, "ip", "at", F.col("outcome") == "failed", 3)
    frames = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding$(), -1" in frames and "-3000000" not in frames
    assert {r.attempt_id: r.n_before for r in found.collect()} == {k: 50 * min(k // 50 + 1, 4) for k in range(500)}
