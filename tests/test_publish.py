"""Published snapshots: what readers see, repeats, failures before the pointer, and objects by content."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrystone.sources import publish


def test_readers_follow_the_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/public"
    assert publish.pointer(spark, root) is None
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    one = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5)], "id long, name string, rate double")
    told = publish.publish(one, root)
    assert told["written"] and sorted(map(tuple, publish.published(spark, root).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    reader = publish.published(spark, root)
    # the same rows in another order are the same content
    assert not publish.publish(one.orderBy(F.desc("id")).repartition(3), root)["written"] and publish.pointer(spark, root)["history"] == [told["content"]]
    two = publish.publish(one.where("id = 1"), root)
    assert two["written"] and publish.published(spark, root).count() == 1 and publish.published(spark, root, back=1).count() == 3 and reader.count() == 3
    publish.publish(one.limit(0), root)
    assert publish.published(spark, root).count() == 0 and publish.published(spark, root).columns == one.columns
    # the first content is older than the history: its files are gone, and no others
    assert sorted(p for p in os.listdir(f"{tmp_path}/public") if not p.startswith(".")) == sorted(["CURRENT.json", f"content-{two['content']}", f"content-{publish.pointer(spark, root)['content']}"])


def test_keys_tell_rows_types_and_repeats_apart(spark):
    key = lambda rows, schema="a long, b string": publish.content_key(spark.createDataFrame(rows, schema))
    base = key([(1, "x"), (2, None)])
    assert base == key([(2, None), (1, "x")]) and len({base, key([(1, "x")]), key([(1, "x"), (2, "")]), key([(1, "x"), (2, None), (2, None)]), key([(1, "x"), (2, None)], "a int, b string"), key([(1, None), (2, "x")]), key([])}) == 7


def test_a_publisher_that_fails_leaves_the_old_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/public"
    publish.publish(spark.range(3), root)
    # the key is worked out from one column; the writer meets the error
    bad = spark.range(5).withColumn("x", F.expr("CASE WHEN id = 4 THEN raise_error('lost') ELSE 'x' END"))
    with pytest.raises(PySparkException):
        publish.publish(bad, root)
    assert publish.published(spark, root).count() == 3
    # files without the mark of their end are written over
    key = publish.content_key(spark.range(7))
    os.makedirs(f"{tmp_path}/public/content-{key}")
    with open(f"{tmp_path}/public/content-{key}/part-0.parquet", "wb") as file:
        file.write(b"half a file")
    assert publish.publish(spark.range(7), root)["written"] and publish.published(spark, root).count() == 7


def test_objects_by_content(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    objects = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x")), ("c", bytearray(b"")), ("d", None)], "key string, body binary")
    index = publish.put(objects, store)
    assert {(r.key, r.size) for r in index.collect()} == {("a", 1), ("b", 1), ("c", 0)} and publish.stored(spark, store).count() == 2
    publish.put(objects, store)
    assert publish.stored(spark, store).count() == 2
    got = publish.get(spark, store, index.select("key", "digest").union(spark.createDataFrame([("z", "0" * 64)], "key string, digest string")))
    assert {(r.key, None if r.body is None else bytes(r.body)) for r in got.collect()} == {("a", b"x"), ("b", b"x"), ("c", b""), ("z", None)}
