"""Exact selection by bits, and the flagger by tiles with halos."""

import math
import random
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reduce, select, tiles, twod
from gridloom.plans.compose import explained
from tests.test_grids import cube


def test_keys_are_bit_patterns_in_order(spark):
    r = random.Random(5)
    values = [2.0**e for e in range(-1074, 1024)]
    values += [math.nextafter(v, to) for v in values for to in (0, math.inf)] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if v == v]
    values += [-v for v in values] + [0.0, -0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for x in rows.select("v", select.ordered_key(F.col("v")).alias("k"), select.from_key(select.ordered_key(F.col("v"))).alias("back")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x["v"])))[0]
        assert x["k"] == (-bits if x["v"] < 0 else bits)
        assert x["back"] == x["v"]
    nan = spark.createDataFrame([(float("nan"),), (math.inf,)], "v double").select("v", select.ordered_key(F.col("v")).alias("k")).collect()
    assert nan[0]["k"] > nan[1]["k"]


def test_keys_by_steps_are_the_same_and_work_out_each_logarithm_once(spark):
    r = random.Random(6)
    values = [2.0**e for e in range(-1074, 1024)]
    values += [math.nextafter(v, to) for v in values for to in (0, math.inf)] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)]
    values += [-v for v in values] + [0.0, -0.0, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = select.with_key(rows, "v").withColumn("k", select.ordered_key(F.col("v"))).collect()
    assert len(got) == len(values) - 1 and all(x["_key"] == x["k"] for x in got)
    seen = []
    whole = select.cut

    def spied(df, name):
        seen.append(explained(df))
        return whole(df, name)

    select.cut, kept = spied, select.cut
    try:
        select.medians(rows.withColumn("g", F.lit(1)), ["g"], "v", 100).collect()
    finally:
        select.cut = kept
    assert 1 <= seen[0].count("LOG2(") <= 3  # once in each rendering of the plan; as one expression, once a branch


@pytest.mark.parametrize("limit", [7, 1 << 20])
def test_selection_equals_sorted_lists(spark, limit):
    r = np.random.default_rng(3)
    groups = {
        "wide": r.normal(0, 1e3, 3000), "tight": 1 + r.random(2000) * 1e-9, "one": np.array([4.25]), "same": np.full(1500, -7.5), "ties": r.integers(-3, 3, 1000) / 2,
        "odd": np.array([math.inf, -math.inf, 5e-324, -5e-324, 0.0, -0.0, 1e308, math.nan]), None: r.normal(5, 1, 40),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("none", None)]
    given = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = {"low": lambda n: F.lit(0), "third": lambda n: F.floor((n - 1) / 3), "high": lambda n: n - 1, "beyond": lambda n: n}
    got = {x["g"]: tuple(x)[1:] for x in select.select(given, ["g"], "v", at, limit).collect()}
    want = {g: (len(vs), *(float(np.sort(vs)[k]) for k in (0, (len(vs) - 1) // 3, len(vs) - 1)), None) for g, vs in groups.items()}
    assert {g: tuple(map(str, x)) for g, x in got.items()} == {g: tuple(str(y + 0.0 if isinstance(y, float) else y) for y in x) for g, x in want.items()}
    clean = given.filter("g <> 'odd'")
    assert {x["g"]: x["value"] for x in select.medians(clean, ["g"], "v", limit).collect()} == {x["g"]: x["m"] for x in clean.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m")).filter("m is not null").collect()}


def test_both_ways_of_reductions_agree(spark):
    r = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, j, float(v)) for i in range(4) for j, v in enumerate(r.normal(0, 1, 101))], "row int, col int, value double")
    for make in (lambda m: reduce.percentile5(rows, method=m), lambda m: reduce.percentile5(rows, column_range=(5, 60), method=m), lambda m: reduce.order_statistic(rows, 17, method=m), lambda m: reduce.order_statistic(rows, 50, halfway=True, method=m), lambda m: reduce.order_statistic(rows, 0, halfway=True, method=m), lambda m: reduce.order_statistic(rows, 101, method=m)):
        assert sorted(map(tuple, make("sort").collect())) == sorted(map(tuple, make("bisect").collect()))
    with pytest.raises(ValueError, match="method"):
        reduce.percentile5(rows, method="guess")


def test_selection_counts_before_the_shuffle_and_sorts_no_group(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.sin("id").alias("v"))
    shift = 64 - select.BITS
    counted = rows.groupBy("g", F.shiftright(select.ordered_key(F.col("v")), shift).alias("p")).agg(F.count("*").alias("k"))
    plan = explained(counted)
    assert "partial_count" in plan
    assert "Python" not in plan and "Sort " not in plan


def simulated(spark, seed=7, shape=(13, 40, 2)):
    r = np.random.default_rng(seed)
    data = np.abs(r.normal(5, 1, shape))
    data[3, :, 0] += 30
    data[:, 7, 1] += 30
    data[5:9, 18:23, :] += 12
    flags = r.random(shape) < 0.05
    flags[:, 12:29, 0] = True  # a gap over several tiles
    flags[::2, :10, 1] = True  # and one at the band's end
    flags[1, :, 1] = True  # and a time without any sample
    data[2, 2, 0] = np.nan
    return cube(spark, data, flags), shape[:2]


PARAMETERS = [
    dict(spike_width_time=0.9, spike_width_freq=0.9, freq_chunks=5, outlier_nsigma=3.5),
    dict(spike_width_time=3, spike_width_freq=2, freq_chunks=3, background_iterations=2, time_extend=2, freq_extend=4, windows_time=(1, 3), windows_freq=(1, 2, 5)),
    dict(spike_width_time=1, spike_width_freq=3, freq_chunks=4, average_freq=3, background_iterations=0, flag_all_time_frac=0.3, flag_all_freq_frac=0.3),
]


@pytest.mark.parametrize("parameters, tile, limit", [(PARAMETERS[0], (4, 9), None), (PARAMETERS[1], (100, 16), None), (PARAMETERS[2], (5, 9), 3)])
def test_tiles_give_the_flags_of_undivided_baselines(spark, parameters, tile, limit, monkeypatch):
    """With a limit, medians of chunks and columns come by selection."""
    c, shape = simulated(spark)
    flagger = twod.SumThresholdFlagger(**parameters)
    want = sorted(map(tuple, flagger.get_flags(c, shape).collect()))
    assert 0 < sum(x[3] for x in want) < len(want)
    if limit:
        monkeypatch.setattr(select, "LIMIT", limit)
    assert sorted(map(tuple, replace(flagger, tile=tile).get_flags(c, shape).collect())) == want


def test_a_stage_by_tiles_has_one_exchange(spark, tmp_path):
    c, shape = simulated(spark)
    c.write.parquet(str(tmp_path / "cube"))
    c = spark.read.parquet(str(tmp_path / "cube"))
    t = tiles.Tiles(shape, 4, 9, twod.chunk_ends(shape[1], 5))
    assert t.channel_ends() == [0, 8, 16, 24, 32, 40]
    columns = c.select("baseline", "channel").distinct().withColumn("_t", F.lit(1.0))
    rows = tiles._backgrounds(t.dealt(c, (8, 8)), t, (2.0, 2.0))
    rows = twod.nearest_known(rows.filter("_own"), (*tiles.KEYS, "time"), "channel", "background")
    assert explained(rows).count("Exchange (") == 1
    rows = twod.threshold_passes(t.dealt(c, (7, 7), columns.limit(0), ("_t",)), (*tiles.KEYS, "channel"), "time", (1, 2, 4), 1.3, "f")
    assert "BroadcastNestedLoop" not in explained(rows)


def test_every_sample_is_in_its_own_tile_once(spark):
    c, shape = simulated(spark)
    t = tiles.Tiles(shape, 4, 16, twod.chunk_ends(shape[1], 5))
    dealt = t.dealt(c, (3, 5))
    assert dealt.filter("_own").count() == c.count()
    assert dealt.groupBy("baseline", "time", "channel", "_bt", "_bc").count().filter("count > 1").count() == 0
    got = {(x["_bt"], x["_bc"]): (x["a"], x["b"], x["c"], x["d"]) for x in dealt.groupBy("_bt", "_bc").agg(F.min("time").alias("a"), F.max("time").alias("b"), F.min("channel").alias("c"), F.max("channel").alias("d")).collect()}
    assert got[(1, 1)] == (1, 10, 11, 36)
