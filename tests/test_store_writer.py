"""Versions of a store: upserts, conflicts, and failures that leave nothing."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from gridloom.sources import store_writer, tuning


def rows(spark, *r):
    return spark.createDataFrame(r, "device_name string, n int")


def test_versions_build_on_one_another(spark, tmp_path):
    at = str(tmp_path / "store")
    assert store_writer.latest(at) == -1
    with pytest.raises(FileNotFoundError):
        tuning.load(spark, at)
    tuning.save(at, rows(spark, ("a", 1), ("b", 2)), ["device_name"])
    tuning.save(at, rows(spark, ("b", 3), ("c", None), (None, 5)), ["device_name"])
    assert sorted(map(str, tuning.load(spark, at).collect())) == sorted(map(str, rows(spark, ("a", 1), ("b", 3), ("c", None), (None, 5)).collect()))
    assert sorted(map(tuple, tuning.load(spark, at, 0).collect())) == [("a", 1), ("b", 2)]
    assert tuning.save(at, rows(spark, ("z", 1)).limit(0), ["device_name"]).count() == 4
    assert store_writer.latest(at) == 1


def test_a_stale_save_is_refused(spark, tmp_path):
    at = str(tmp_path / "store")
    tuning.save(at, rows(spark, ("a", 1)), ["device_name"])
    tuning.save(at, rows(spark, ("a", 2)), ["device_name"], on=0)
    before = sorted(os.listdir(at))
    with pytest.raises(store_writer.Conflict):
        tuning.save(at, rows(spark, ("a", 3)), ["device_name"], on=0)
    assert sorted(os.listdir(at)) == before
    assert tuning.load(spark, at).collect()[0]["n"] == 2


def test_of_saves_at_the_same_time_one_wins(spark, tmp_path):
    at, done = str(tmp_path / "store"), []
    tuning.save(at, rows(spark, ("a", 0)), ["device_name"])

    def one(k):
        try:
            tuning.save(at, rows(spark, (f"d{k}", k)), ["device_name"], on=0)
            done.append(k)
        except store_writer.Conflict:
            done.append(None)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for k in done if k is not None]
    assert len(done) == 4
    assert len(won) == 1
    assert sorted(map(tuple, tuning.load(spark, at).collect())) == [("a", 0), (f"d{won[0]}", won[0])]
    assert sorted(os.listdir(at)) == ["version=0", "version=1"]


def test_a_task_that_fails_leaves_no_rows(spark, tmp_path):
    at = str(tmp_path / "store")
    tuning.save(at, rows(spark, ("a", 0)), ["device_name"])
    bad = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("device_name"), F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("int")).otherwise(1).alias("n"))
    with pytest.raises(Exception, match="lost"):
        store_writer.write_version(bad, at, 0)
    assert os.listdir(at) == ["version=0"]
    assert tuning.load(spark, at).count() == 1
