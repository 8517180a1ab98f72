"""Samples located in intervals against plain loops, without a nested-loop join."""

import random

import pytest

from gridloom.operators.intervals import locate
from gridloom.plans.compose import explained


def test_every_pair_is_found_once(spark):
    r = random.Random(1)
    spans = [(f"k{r.randint(0, 2)}", low, low + n, i) for i, (low, n) in enumerate([(r.randint(-3000, 3000), r.choice([0, 1, 2, 15, 16, 17, 255, 256, 300, 5000, -4])) for _ in range(120)])]
    spans += [("k0", None, 5, 900), ("k0", 5, None, 901), (None, 0, 9, 902), ("k1", 10, 40, 903), ("k1", 10, 40, 903)]
    samples = [(f"k{r.randint(0, 3)}", r.randint(-3200, 9000), i) for i in range(300)] + [("k0", None, 400), (None, 3, 401), ("k1", 20, 402), ("k1", 20, 402)]
    a = spark.createDataFrame(samples, "key string, at long, sample int").repartition(3)
    b = spark.createDataFrame(spans, "key string, low long, high long, span int").repartition(2)
    want = [(k, at, i, low, high, j) for k, at, i in samples for q, low, high, j in spans if k is not None and k == q and None not in (at, low, high) and low <= at < high]
    assert sorted(map(tuple, locate(a, b, "at", keys=["key"]).collect())) == sorted(want)
    left = locate(a, b, "at", keys=["key"], how="left").collect()
    without = [(k, at, i, None, None, None) for k, at, i in samples if not any(x[2] == i for x in want)]
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, want + without))


def test_many_uneven_intervals_need_no_nested_loop(spark):
    spans = spark.range(100_000).selectExpr("id * 7 + id % 5 as low", "id * 7 + id % 5 + 1 + (id % 977) * (id % 13) as high", "id as span")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = locate(spark.range(5000).selectExpr("id * 131 as at"), spans, "at")
        plan = explained(found)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        n = found.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ats = [i * 131 for i in range(5000)]
    import bisect

    want = 0
    for i in range(100_000):
        low = i * 7 + i % 5
        want += bisect.bisect_left(ats, low + 1 + (i % 977) * (i % 13)) - bisect.bisect_left(ats, low)
    assert n == want


def test_no_intervals_and_errors(spark):
    a, b = spark.createDataFrame([(1,)], "at int"), spark.createDataFrame([], "low int, high int")
    assert locate(a, b, "at").collect() == []
    assert [tuple(x) for x in locate(a, b, "at", how="left").collect()] == [(1, None, None)]
    with pytest.raises(ValueError, match="both sides"):
        locate(a, b.withColumnRenamed("low", "at"), "at", low="at")
    with pytest.raises(ValueError, match="join"):
        locate(a, b, "at", how="outer")
