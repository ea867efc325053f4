"""The stored table and compact stream output."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.session import delete, new_path
from tallyloom.sources import store as S


def upsert(known, new):
    return known.join(new.select("id"), "id", "left_anti").unionByName(new)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def made(spark, name="store"):
    path = new_path(spark, name).removeprefix("file:")
    first = spark.createDataFrame([(f"k{i}", i) for i in range(40)] + [(None, -1)], "id string, v long")
    store = S.Store(spark, path, "id", first.schema, buckets=8)
    assert store.read().count() == 0
    store.write(first, lambda known, new: new)
    return store, {r.id: r.v for r in first.collect()}


def test_only_touched_buckets_change(spark):
    store, want = made(spark)
    before = files(store.path)
    touched = store.write(spark.createDataFrame([("k3", 99), ("k3x", 5)], "id string, v long"), upsert)
    assert {r.id: r.v for r in store.read().collect()} == want | {"k3": 99, "k3x": 5}
    after = files(store.path)
    assert all(after[f] == t for f, t in before.items()) and len(touched) <= 2
    assert {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)} <= {str(b) for b in touched}
    assert store.write(spark.createDataFrame([], "id string, v long"), upsert) == set()
    assert store.vacuum() == len(touched) and store.vacuum() == 0
    assert {r.id: r.v for r in store.read().collect()} == want | {"k3": 99, "k3x": 5}


def test_a_write_that_broke_off_is_not_seen(spark, monkeypatch):
    store, want = made(spark)
    change = spark.createDataFrame([("k1", 7)], "id string, v long")
    with monkeypatch.context() as m:
        m.setattr(S.Store, "_commit", lambda self, version, touched: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.write(change, upsert)
    assert {r.id: r.v for r in store.read().collect()} == want
    store.write(change, upsert)
    assert {r.id: r.v for r in store.read().collect()} == want | {"k1": 7}


def test_buckets_may_become_empty(spark):
    store, want = made(spark)
    ids = spark.createDataFrame([(f"k{i}",) for i in range(40)], "id string")
    store.write(ids, lambda known, gone: known.join(gone, "id", "left_anti"))
    assert [(r.id, r.v) for r in store.read().collect()] == [(None, -1)]
    store.write(spark.createDataFrame([("k1", 7)], "id string, v long"), upsert)
    assert store.read().count() == 2


def test_compact_output_adds_up_the_same(spark):
    path = new_path(spark, "batches")
    batch = lambda n, rows: spark.createDataFrame(rows, "k string, v long").write.parquet(f"{path}/batch={n}")
    total = lambda: {r.k: r.v for r in S.read_batches(spark, path).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    fold = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    batch(0, [("a", 1), ("b", 2)])
    batch(1, [("a", 10)])
    assert total() == {"a": 11, "b": 2}
    S.compact_batches(spark, path, fold)
    S.compact_batches(spark, path, fold)
    assert total() == {"a": 11, "b": 2} and S.read_batches(spark, path).count() == 2
    batch(2, [("b", 5), ("c", 1)])
    assert total() == {"a": 11, "b": 7, "c": 1}
    S.compact_batches(spark, path, fold)
    assert total() == {"a": 11, "b": 7, "c": 1} and S.read_batches(spark, path).count() == 3
    assert delete(spark, path) and not delete(spark, path)
