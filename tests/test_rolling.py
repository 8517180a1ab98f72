"""Rolling medians by rank updates against sorted windows and against the window function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import rfi, rolling
from gridloom.plans.compose import explained


def plain(values, width):
    out = np.full(len(values), np.nan)
    for i in range(len(values)):
        x = values[max(0, i - width // 2) : i + (width - 1) // 2 + 1]
        x = np.sort(x[~np.isnan(x)])
        if len(x):
            low, high = x[(len(x) - 1) // 2], x[len(x) // 2]
            out[i] = low if len(x) % 2 else low * 0.5 + high * 0.5
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 13, 64, 1001])
def test_medians_equal_sorted_windows(width, monkeypatch):
    r = np.random.default_rng(width)
    for n in (0, 1, 5, 100, 2500):
        v = r.normal(0, 1, n)
        v[r.random(n) < 0.3] = np.nan
        v[r.random(n) < 0.3] = 1.5
        assert np.array_equal(rolling.rolling_medians(v, width), plain(v, width), equal_nan=True)
    monkeypatch.setattr(rolling, "COUNTS", 1)
    assert np.array_equal(rolling.rolling_medians(v[:300], width), plain(v[:300], width), equal_nan=True)


@pytest.mark.parametrize("width, step", [(13, 1 << 17), (13, 50), (8, 7), (1001, 300)])
def test_both_backgrounds_agree(spark, width, step, monkeypatch):
    """Runs shorter than a series, a window or both; series of many lengths, with gaps between channels, nulls and NaN."""
    # The workers get the package's source, so their STEP is set through the closure.
    r, rows = np.random.default_rng(9), []
    for baseline, n in enumerate((1, 2, 9, 40, 150, 700)):
        v = r.normal(0, 2, n)
        rows += [(f"b{baseline}", int(k * 3), None if r.random() < 0.1 else float("nan") if r.random() < 0.1 else float(x)) for k, x in enumerate(v)]
    vis = spark.createDataFrame(rows, "baseline string, channel int, value double").withColumn("note", F.lit("x")).repartition(3)
    flags = vis.select("channel", (F.col("channel") % 5 == 0).cast("int").alias("flag")).distinct()
    monkeypatch.setattr(rolling, "STEP", step)
    for extra in ({}, {"use_flags": rfi.CHANNEL, "drop_negative": True}):
        given = flags if extra else None
        want = rfi.MedianBackground(width, amplitudes=True, **extra)(vis, given)
        got = rolling.RankedMedianBackground(width, amplitudes=True, **extra)(vis, given)
        assert sorted(want.columns) == sorted(got.columns)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_flagger_takes_either_background(spark):
    r = np.random.default_rng(2)
    vis = spark.createDataFrame([(b, c, float(x)) for b in range(3) for c, x in enumerate(np.abs(r.normal(0, 1, 90)) + 40 * (r.random(90) < 0.03))], "baseline int, channel int, value double")
    flags = [rfi.Flagger(b, rfi.MadNoise(), rfi.SumThreshold(9.0))(vis).select("baseline", "channel", "flag") for b in (rfi.MedianBackground(13, amplitudes=True), rolling.RankedMedianBackground(13, amplitudes=True))]
    a, b = (sorted(map(tuple, f.collect())) for f in flags)
    assert a == b
    assert any(x[2] for x in a)
    assert explained(flags[1]).count("MapInArrow (") >= 1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "baseline int, channel int, value double")
    assert rolling.RankedMedianBackground(5, amplitudes=True)(empty).collect() == []
    with pytest.raises(ValueError, match="positive"):
        rolling.RankedMedianBackground(0, amplitudes=True)(empty)
