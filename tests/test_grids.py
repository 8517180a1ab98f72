import asyncio
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import functions as fn
from gridloom import schema
from gridloom.operators import basic, fft, kernel, reduce, rfi, twod
from gridloom.plans import compose, jobs
from gridloom.sources import grids, npy, tuning
from gridloom.streaming import flag_stream


def long(spark, array, axes=("channel", "baseline")):
    return grids.from_array(spark, np.asarray(array), axes)


def values(df, axes, column="value"):
    return {tuple(r[a] for a in axes): r[column] for r in df.collect()}


def as_rows(df, axes, column="value"):
    got = values(df, axes, column)
    return [got[k] for k in sorted(got)]


# The literal inputs and results of the tests named "literals" define the semantics and must stay as they are.
VIS = np.array([[1.25], [1.5j], [1.0], [2.0], [-1.75], [2.0]])


def test_median_background_literals(spark):
    vis = long(spark, VIS)
    assert as_rows(rfi.MedianBackground(3)(vis), ("channel", "baseline"), "dev") == [-0.125, 0.25, -0.5, 0.25, -0.25, 0.125]
    flags = spark.createDataFrame(list(enumerate([0, 0, 1, 0, 0, 4])), "channel int, flag smallint")
    got = rfi.MedianBackground(3, use_flags=True)(vis, flags)
    assert as_rows(got, ("channel", "baseline"), "dev") == [-0.125, 0.125, 0.0, 0.125, -0.125, 0.0]
    full = spark.createDataFrame([(0, i, f) for i, f in enumerate([0, 0, 1, 0, 0, 4])], "baseline int, channel int, flag smallint")
    assert as_rows(rfi.MedianBackground(3, use_flags="full")(vis, full), ("channel", "baseline"), "dev") == [-0.125, 0.125, 0.0, 0.125, -0.125, 0.0]
    with pytest.raises(TypeError):
        rfi.MedianBackground(3)(vis, flags)
    with pytest.raises(TypeError):
        rfi.MedianBackground(3, use_flags=True)(vis)
    with pytest.raises(ValueError):
        rfi.MedianBackground(3, use_flags="row")(vis, flags)


def test_negative_and_missing_amplitudes(spark):
    grid = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, -5.0, float("nan"), None, 3.0])], "baseline int, channel int, value double")
    host = as_rows(rfi.MedianBackground(5, amplitudes=True)(grid), ("channel",), "dev")
    assert host == [1.0 - -2.0, -5.0 - -2.0, 0.0, 0.0, 0.0]
    device = as_rows(rfi.MedianBackground(5, amplitudes=True, drop_negative=True)(grid), ("channel",), "dev")
    assert device == [0.0, 0.0, 0.0, 0.0, 0.0]


def test_noise_literals(spark):
    dev = long(spark, [[0, 3, 2.4], [1.5, -1.4, 4.6], [0, 1.1, 3.3], [5, 0, -3.1]]).withColumnRenamed("value", "dev")
    noise = values(rfi.MadNoise().table(dev), ("baseline",), "noise")
    assert [noise[k,] for k in range(3)] == pytest.approx([3.25 * 1.4826, 1.4 * 1.4826, 3.2 * 1.4826])
    none = rfi.SimpleThreshold(2.0)(rfi.MadNoise()(dev.withColumn("dev", F.lit(0.0))))
    assert {r["flag"] for r in none.collect()} == {0}


def sum_threshold(dev, noise, n_sigma, n_windows=4, falloff=1.2):
    dev, flags = dev.copy(), np.zeros(len(dev), bool)
    for i in range(n_windows):
        w, thr = 2**i, np.float32(n_sigma * noise * falloff**-i)
        dev[flags] = thr
        hits = [j for j in range(len(dev) - w + 1) if dev[j : j + w].sum() > float(thr) * w]
        for j in hits:
            flags[j : j + w] = True
    return flags


def test_sum_threshold_equals_numpy(spark):
    r = np.random.default_rng(3)
    dev = r.normal(0, 10, (117, 12))
    dev[r.random(dev.shape) < 0.25] += 200
    grid = long(spark, dev).withColumnRenamed("value", "dev").withColumn("noise", F.col("baseline") * 5.0)
    got = grids.to_array(rfi.SumThreshold(2.0, flag_value=7)(grid), value="flag")
    want = np.stack([sum_threshold(dev[:, b], b * 5.0, 2.0) for b in range(12)], 1)
    assert (got == want * 7).all()
    short = grid.filter("channel < 3")
    assert rfi.SumThreshold(2.0)(short).count() == 36


def test_flagger_finds_injected_spikes(spark):
    r = np.random.default_rng(1)
    vis = r.normal(size=(117, 20)) + 1j * r.normal(size=(117, 20))
    spikes = r.random(vis.shape) < 1 / 32
    vis[spikes] = 60 + 5 * r.random(spikes.sum())
    pre = r.random(vis.shape) < 1 / 16
    flags = long(spark, pre.astype(int) * 2).withColumnRenamed("value", "flag")
    for threshold in (rfi.SimpleThreshold(11.0), rfi.SumThreshold(11.0)):
        flagger = rfi.Flagger(rfi.MedianBackground(13, use_flags="full"), rfi.MadNoise(), threshold)
        got = grids.to_array(flagger(long(spark, vis), flags), value="flag") != 0
        assert not got[pre].any()  # flagged input has deviation 0
        if isinstance(threshold, rfi.SimpleThreshold):
            assert (got == (spikes & ~pre)).all()
        assert got[spikes & ~pre].all()
    more = flagger(long(spark, vis).repartition(7), flags)
    assert (grids.to_array(more, value="flag") != 0).sum() == got.sum()


def cube(spark, data, flags=None):
    data = np.asarray(data, float)
    flags = np.zeros(data.shape, bool) if flags is None else flags
    axes = ("time", "channel", "baseline")
    return long(spark, data, axes).join(long(spark, flags, axes).withColumnRenamed("value", "flag"), list(axes))


def test_frequency_averaging_literals(spark):
    data = np.repeat((6 * np.arange(5)[:, None] + np.arange(6))[:, :, None], 2, 2)
    flags = np.zeros(data.shape, bool)
    flags[3, :, 0] = flags[:, 4, 0] = True
    flags[2, 0] = flags[2, 5] = True
    c = cube(spark, data, flags)
    for factor, zero, one in (
        (2, [[0.5, 2.5, 5], [6.5, 8.5, 11], [13, 14.5, 0], [0, 0, 0], [24.5, 26.5, 29]], [[0.5, 2.5, 4.5], [6.5, 8.5, 10.5], [13, 14.5, 16], [18.5, 20.5, 22.5], [24.5, 26.5, 28.5]]),
        (4, [[1.5, 5], [7.5, 11], [14, 0], [0, 0], [25.5, 29]], [[1.5, 4.5], [7.5, 10.5], [14, 16], [19.5, 22.5], [25.5, 28.5]]),
    ):
        got = twod.average_freq(c, factor)
        assert grids.to_array(got.filter("baseline = 0"), ("time", "channel")).tolist() == zero
        assert grids.to_array(got.filter("baseline = 1"), ("time", "channel")).tolist() == one
        flagged = {(r["baseline"], r["time"], r["channel"]) for r in got.filter("flag").collect()}
        assert flagged == {(0, 3, k) for k in range(len(zero[0]))} | {(0, 2, len(zero[0]) - 1)}


def test_time_median_literals(spark):
    data = np.array([[2, 1, 2, 5], [3, 1, 8, 6], [4, 1, 4, 7], [5, 1, 5, 6.5], [1.5, 1, 1.5, 5.5]])[:, :, None]
    flags = np.array([[0, 1, 0, 1], [0, 1, 1, 0], [0, 1, 0, 1], [0, 1, 0, 1], [0, 1, 0, 1]], bool)[:, :, None]
    got = twod.time_median(cube(spark, data, flags))
    assert as_rows(got, ("channel",)) == [3, 0, 3, 6]
    assert as_rows(got, ("channel",), "flag") == [False, True, False, False]


def test_median_abs_literals(spark):
    data = np.array([[-2, -6, 4.5], [1.5, 3.3, 0.5]])[:, :, None]
    flags = np.zeros(data.shape, bool)
    flags[1, 1] = True
    assert as_rows(twod.median_abs(cube(spark, data, flags)), ("baseline",)) == [2.0]
    assert as_rows(twod.median_abs(cube(spark, data, flags), ("channel",)), ("channel",)) == [1.75, 6.0, 2.5]
    flags[:, 1] = True
    assert as_rows(twod.median_abs(cube(spark, data, flags), ("channel",)), ("channel",)) == [1.75, None, 2.5]
    assert as_rows(twod.median_abs(cube(spark, data, np.ones(data.shape, bool))), ("baseline",)) == [None]


def test_gap_interpolation_literals(spark):
    n = None
    rows = [(0, 0, i, v) for i, v in enumerate([n, n, 4.0, n, n, 10.0, n, -2.0, n, n])] + [(0, 1, i, float("nan")) for i in range(3)]
    got = twod.interpolate_gaps(spark.createDataFrame(rows, "baseline int, time int, channel int, value double"))
    assert as_rows(got.filter("time = 0"), ("channel",)) == [4, 4, 4, 6, 8, 10, 4, -2, -2, -2]
    assert as_rows(got.filter("time = 1"), ("channel",)) == [0, 0, 0]


def test_box_filter_literals(spark):
    row = np.array([50, 10, 60, -70, 30, 20, -15.0])[None, :, None]
    one = twod.box_filter(cube(spark, row), ("baseline", "time"), "channel", 2, 7, 1)
    assert as_rows(one, ("channel",)) == pytest.approx([24, 10, 16, 10, 5, -7, 7])
    four = twod.box_filter(cube(spark, row), ("baseline", "time"), "channel", 2, 7, 4)
    assert as_rows(four, ("channel",)) == pytest.approx([10.864, 10.96, 10.008, 8.176, 6.208, 4.176, 2.44])
    single = twod.box_sums(cube(spark, row[:, :1]), ("baseline", "time"), "channel", 1, 1, ["value"], 1)
    assert as_rows(single, ("channel",)) == [50]


def test_masked_gaussian_of_constants(spark):
    r = np.random.default_rng(2)
    flags = r.random((20, 16, 1)) < 0.5
    got = twod.masked_gaussian(cube(spark, np.full((20, 16, 1), 7.5), flags), (2.0, 1.5), (20, 16))
    assert as_rows(got, ("time", "channel"), "background") == pytest.approx([7.5] * 320)
    none = twod.masked_gaussian(cube(spark, np.ones((4, 4, 1)), np.ones((4, 4, 1), bool)), (2.0, 1.5), (4, 4))
    assert set(as_rows(none, ("time", "channel"), "background")) == {None}
    with pytest.raises(ValueError):
        twod.gaussian(cube(spark, np.ones((4, 4, 1))), (1.0,), (4, 4))


def test_sum_threshold_two_sided(spark):
    r = np.random.default_rng(5)
    data = r.normal(0, 3, (60, 40, 1))
    flags = np.zeros(data.shape, bool)
    flags[:30] = True
    data[:30] = 1000 * r.normal(size=(30, 40, 1))
    data[45, :4, 0] = 8, -8, 40, -40
    got = grids.to_array(twod.sum_threshold(cube(spark, data, flags), "time", [1], 5.0, 1.3), ("time", "channel"), "found")
    assert got[45, :4].tolist() == [False, False, True, True]
    all_flagged = twod.sum_threshold(cube(spark, data, np.ones(data.shape, bool)), "channel", [1, 2, 4], ends=[0, 10, 40])
    assert all_flagged.filter("found").count() == 0
    with pytest.raises(ValueError):
        twod.sum_threshold(cube(spark, data, flags), "baseline", [1])


def test_twod_flagger_on_simulated_interference(spark):
    r = np.random.default_rng(1)
    times, channels = 60, 96
    data = 5 + np.polyval([2, -1, 0.5, 1], np.linspace(-1, 1, channels))[None, :] + r.normal(0, 0.1, (times, channels))
    rfi_at = np.zeros(data.shape, bool)
    rfi_at[12, 10:70] = rfi_at[:, 40] = True
    rfi_at[30:33, 50:60] = True
    data[rfi_at] += 5
    data[50, 85] = np.nan
    flagger = twod.SumThresholdFlagger(freq_chunks=4)
    got = grids.to_array(flagger.get_flags(cube(spark, data[:, :, None]), (times, channels)), ("time", "channel"), "flag")
    assert got[rfi_at].all()
    assert got[50, 85]
    wide = np.zeros(data.shape, bool)
    for t, f in zip(*np.nonzero(rfi_at), strict=True):
        wide[max(t - 1, 0) : t + 2, max(f - 1, 0) : f + 2] = True
    wide[50, 85] = True
    assert (got & ~wide)[:, 8:-8].mean() < 0.05
    nothing = flagger.get_flags(cube(spark, np.zeros((20, 30, 2)), np.ones((20, 30, 2), bool)), (20, 30))
    assert nothing.filter("flag").count() == 0


def test_reductions(spark):
    r = np.random.default_rng(4)
    a = r.integers(0, 100_000, (29, 73))
    grid = long(spark, a, ("row", "col"))
    assert as_rows(reduce.hreduce(grid, "sum", column_range=(27, 68), size=73), ("row",)) == a[:, 27:68].sum(1).tolist()
    assert as_rows(reduce.hreduce(grid, lambda x, y: F.greatest(x, y), 0), ("row",)) == a.max(1).tolist()
    for bad, error in (((5, 5), ValueError), ((0, 99), IndexError), ((-1, 3), IndexError)):
        with pytest.raises(error):
            reduce.hreduce(grid, "sum", column_range=bad, size=73)
    five = reduce.percentile5(grid.withColumn("value", F.col("value").cast("double")), column_range=(3, 50), size=73).collect()
    want = np.sort(a[:, 3:50], 1)
    for x in five:
        assert [x[k] for k in ("min", "max", "q25", "q75", "q50")] == [want[x["row"], i] for i in (0, 46, 11, 34, 23)]
    with pytest.raises(ValueError):
        reduce.percentile5(grid, column_range=(0, 73), size=73, max_columns=50)
    z = r.normal(size=(40, 6)) + 1j * r.normal(size=(40, 6))
    mask = r.random(40)
    table = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mask)], "row int, mask double")
    got = {x["col"]: complex(x["re"], x["im"]) for x in reduce.masked_sum(long(spark, z, ("row", "col")), table).collect()}
    assert [got[c] for c in range(6)] == pytest.approx((mask[:, None] * z).sum(0).tolist())
    points = reduce.ranks(grid, spark.createDataFrame([(float(x),) for x in (0, 10, 50_000, 99_999, 200_000)], "point double"))
    assert values(points, ("point",), "below") == {(float(x),): int((a < x).sum()) for x in (0, 10, 50_000, 99_999, 200_000)}


def test_rank_literals(spark):
    for data, want in (([5.3], 5.3), ([1.2, 2.3, 3.4, 4.5], 2.85), ([0, 0, 0, 1.2, 5.3, 2.4], 2.4)):
        df = spark.createDataFrame([(float(x),) for x in data], "v double")
        assert df.agg(fn.median_nonzero(F.col("v"))).first()[0] == pytest.approx(want)
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in (-10.0, 5.5, nan, -20.0, nan)], "v double")
    assert tuple(df.agg(fn.fmin(F.col("v")), fn.fmax(F.col("v"))).first()) == (-20, 5.5)
    assert all(np.isnan(x) for x in df.filter("isnan(v)").agg(fn.fmin(F.col("v")), fn.fmax(F.col("v"))).first())
    assert (fn.divup(7, 2), fn.roundup(7, 4)) == (4, 8)


def test_regions(spark):
    a, shape = np.arange(63).reshape(7, 9), {"row": 7, "col": 9}
    grid = long(spark, a, ("row", "col"))
    got = grids.to_array(basic.region(grid, {"row": slice(1, 6, 2), "col": (-5, 9)}, shape), ("row", "col"))
    assert (got == a[1:6:2, -5:9]).all()
    b = a.copy()
    b[2:5, 1:9:3] = -a[0:3, 4:7]
    copied = basic.region_copy(grid, basic.scale(grid, -1), {"row": (0, 3), "col": (4, 7)}, {"row": (2, 5), "col": (1, 9, 3)}, shape, shape)
    assert (grids.to_array(copied, ("row", "col")) == b).all()
    for bad, error in (({"row": (5, 5)}, IndexError), ({"row": 7}, IndexError), ({"row": slice(0, 3, -1)}, IndexError), ({"depth": 1}, IndexError), ({"row": 1.5}, TypeError), ({"row": (0, 8)}, IndexError)):
        with pytest.raises(error):
            basic.canonical(bad, shape)
    with pytest.raises(ValueError):
        basic.region_copy(grid, grid, {"row": (0, 2)}, {"row": (0, 3)}, shape, shape)
    with pytest.raises(TypeError):
        basic.region_write(grid, grid.withColumn("value", F.lit("x")), {}, shape)
    assert (grids.to_array(basic.transpose(grid), ("row", "col")) == a.T).all()
    assert basic.fill(spark, {"row": 3, "col": 0}).count() == 0


@pytest.mark.parametrize(("kind", "shape"), [("c2c", (16, 12)), ("r2c", (3, 5)), ("r2c", (8,)), ("c2r", (4, 7)), ("c2r", (4, 6))])
def test_fft_equals_numpy(spark, kind, shape):
    r = np.random.default_rng(1)
    z = r.normal(size=(5, *shape)) + 1j * r.normal(size=(5, *shape))
    axes = tuple(range(1, len(shape) + 1))
    given = np.fft.rfftn(z.real, axes=axes) if kind == "c2r" else z
    df = spark.createDataFrame([(i, x.real.ravel().tolist(), x.imag.ravel().tolist()) for i, x in enumerate(given)], "id int, re array<double>, im array<double>")
    for mode in ("forward", "inverse") if kind == "c2c" else ("inverse",) if kind == "c2r" else ("forward",):
        got = {x["id"]: x for x in fft.fft(df, shape, kind, mode).collect()}
        size = np.prod(shape)
        want = {"c2c": np.fft.fftn(z, axes=axes) if mode == "forward" else np.fft.ifftn(z, axes=axes) * size, "r2c": np.fft.rfftn(z.real, axes=axes), "c2r": z.real * size}[kind]
        for i in range(5):
            assert np.allclose(got[i]["re"], want[i].real.ravel())
            if kind != "c2r":
                assert np.allclose(got[i]["im"], want[i].imag.ravel())
    for bad in (("r2c", "inverse"), ("c2r", "forward"), ("c2x", "forward")):
        with pytest.raises(ValueError):
            fft.fft(df, shape, *bad)


def test_npy_source(spark, tmp_path):
    r = np.random.default_rng(0)
    a = (r.normal(size=(3, 4, 2)) + 1j * r.normal(size=(3, 4, 2))).astype(np.complex64)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "b.txt").write_text("no")
    got = npy.read_npy(spark, f"{tmp_path}/")
    assert got.count() == 24
    assert np.allclose(grids.to_array(got, ("time", "channel", "baseline"), "im"), a.imag)
    with pytest.raises(ValueError):
        npy.read_npy(spark, "x.hdf5")


def test_generated_data_is_reproducible(spark):
    a, b = (grids.generate(spark, 4, 5, 6).agg(F.sum("re"), F.sum("im"), F.count("*")).first() for _ in range(2))
    assert a == b
    assert a[2] == 120


def test_tuning_store(spark):
    rows = [("gpu", "cuda", "1", 64, 4), ("gpu", "cuda", "2", 64, 8), ("gpu", "opencl", "1", 32, 2)]
    store = spark.createDataFrame(rows, "device_name string, device_platform string, device_version string, arg_n int, value_w int")
    look = lambda nearest=True, **k: [(r["value_w"], r["match_level"]) for r in tuning.lookup(store, k, nearest).collect()]
    device = {"device_name": "gpu", "device_platform": "cuda", "device_version": "2"}
    assert look(**device, arg_n=64) == [(8, 0)]
    assert look(**device | {"device_version": "9"}, arg_n=64)[0][1] == 1
    assert look(**device, arg_n=32) == [(2, 2)]
    assert look(**device | {"device_name": "other"}, arg_n=32) == [(2, 3)]
    assert look(False, **device, arg_n=32) == []
    assert look(**device, arg_n=7) == []
    new = tuning.upsert(store, spark.createDataFrame([("gpu", "cuda", "2", 64, 16), ("new", "cuda", "1", 1, 1)], store.schema), ["device_name", "device_platform", "device_version", "arg_n"])
    assert sorted(r["value_w"] for r in new.collect()) == [1, 2, 4, 16]
    with pytest.raises(ValueError):
        tuning.lookup(store, {"arg_x": 1})


def test_composition(spark):
    grid = long(spark, np.arange(12.0).reshape(4, 3), ("row", "col"))
    slot = schema.Slot({"row": "integer", "col": "integer", "value": "number"})
    scale = compose.Operation("scale", lambda src: basic.scale(src, 2.0), {"src": slot})
    total = compose.Operation("sum", lambda src: reduce.hreduce(src, "sum"), {"src": slot})
    both = compose.Sequence((scale, total), {"scale.out": "scaled", "sum.src": "scaled", "scale.src": "data"})
    assert list(both.inputs) == ["data"]
    assert as_rows(both(data=grid)["sum.out"], ("row",)) == [6, 24, 42, 60]
    assert '"scaled" -> "sum"' in both.graph()
    assert "HashAggregate" in compose.explained(both(data=grid)["sum.out"])
    with pytest.raises(ValueError):
        both(other=grid)
    with pytest.raises(TypeError):
        both(data=grid.withColumn("value", F.lit("x")))
    with pytest.raises(ValueError):
        both(data=grid.drop("col"))
    with pytest.raises(ValueError):
        compose.Sequence((scale,), {"scale.nothing": "x"})
    vectors = schema.to_vectors(grid, "row", "col")
    assert as_rows(schema.to_long(vectors, "row", "col"), ("row", "col")) == list(range(12))
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (1.0,)], "v double").select(schema.finite(F.col("v"))).collect()] == [None, 1.0]


def test_padded_sum_threshold_equals_a_band_with_zeros_around(spark):
    r = np.random.default_rng(5)
    dev = r.normal(0, 1, (30, 6))
    dev[:2, 0] = dev[-1:, 1] = dev[-3:, 2] = 4
    dev[0, 3] = 9
    wide = np.vstack([np.zeros((15, 6)), dev, np.zeros((15, 6))])
    noise = [(b, 1.0) for b in range(6)]
    noise = spark.createDataFrame(noise, "baseline int, noise double")
    dev[:4, 4] = [0.9, 0.9, 0.9, -1]
    wide[15:45] = dev
    of = lambda a, padded, falloff=1.2: grids.to_array(rfi.SumThreshold(2.0, falloff=falloff, padded=padded)(long(spark, a).withColumnRenamed("value", "dev").join(noise, "baseline")), value="flag")
    assert of(dev, True).tolist() == of(wide, False)[15:45].tolist()
    assert of(dev, True, 2.0).tolist() == of(wide, False, 2.0)[15:45].tolist()
    assert of(dev, True, 2.0)[:3, 4].all()
    assert not of(dev, False, 2.0)[:3, 4].any()
    assert rfi.SumThreshold(2.0, padded=True)(long(spark, dev[:1]).withColumnRenamed("value", "dev").join(noise, "baseline")).count() == 6


def test_errors_that_data_decide(spark):
    dev = long(spark, np.ones((9, 2))).withColumnRenamed("value", "dev")
    assert rfi.MadNoise(9).table(dev).count() == 2
    for failing in (rfi.MadNoise(8).table(dev), rfi.MadNoise(8)(dev), reduce.block_sum(spark.range(200).selectExpr("id as i", "1.0D as value"))):
        with pytest.raises(Exception, match="more than 8|no multiple"):
            failing.collect()
    assert reduce.block_sum(spark.range(256).selectExpr("id as i", "1.0D as value")).count() == 2
    assert reduce.block_sum(spark.range(200).selectExpr("id as i", "1.0D as value"), whole=False).count() == 2


def test_flags_of_any_width(spark):
    data = np.arange(24.0).reshape(4, 6, 1)
    flags = np.zeros(data.shape, bool)
    flags[1] = flags[:, 2] = True
    c = cube(spark, data, flags)
    want = sorted(map(tuple, twod.SumThresholdFlagger().get_flags(c, (4, 6)).collect()))
    for kind in ("tinyint", "smallint", "bigint"):
        narrow = c.withColumn("flag", F.col("flag").cast("int").cast(kind))
        assert as_rows(twod.average_freq(narrow, 3), ("time", "channel")) == as_rows(twod.average_freq(c, 3), ("time", "channel"))
        assert as_rows(twod.time_median(narrow), ("channel",), "flag") == as_rows(twod.time_median(c), ("channel",), "flag")
        complex_ = narrow.select("*", F.col("value").alias("re"), F.lit(0.0).alias("im")).drop("value")
        assert as_rows(twod.average_freq(complex_, 2), ("time", "channel")) == as_rows(twod.average_freq(c, 2), ("time", "channel"))
    assert sorted(map(tuple, twod.SumThresholdFlagger(check_dense=True).get_flags(narrow, (4, 6)).collect())) == want
    with pytest.raises(TypeError):
        twod.time_median(c.withColumn("flag", F.lit("yes")))
    assert [schema.narrowest(x).simpleString() for x in (0, 127, 128, -129, 40000, 1 << 40)] == ["tinyint", "tinyint", "smallint", "smallint", "int", "bigint"]
    with pytest.raises(OverflowError):
        schema.narrowest(1 << 70)


def test_large_baselines_are_split_with_the_same_flags(spark, monkeypatch):
    r = np.random.default_rng(7)
    data = np.abs(r.normal(5, 1, (12, 20, 2)))
    data[3, :, 0] += 30
    data[:, 7, 1] += 30
    c, flagger = cube(spark, data, r.random(data.shape) < 0.05), twod.SumThresholdFlagger(spike_width_time=3, spike_width_freq=3, freq_chunks=3)
    want = sorted(map(tuple, flagger.get_flags(c, (12, 20)).collect()))
    assert any(x[3] for x in want)
    monkeypatch.setattr(twod, "CELLS_A_TASK", 0)
    assert sorted(map(tuple, flagger.get_flags(c, (12, 20)).collect())) == want


def test_a_cube_with_gaps_is_refused_or_filled(spark):
    c = cube(spark, np.ones((3, 4, 2)))
    assert twod.require_dense(c, {"time": 3, "channel": 4}) is c
    for bad in (c.filter("not (time = 1 and channel = 2 and baseline = 1)"), c.unionByName(c.limit(1)), c.withColumn("channel", F.when(F.col("channel") == 3, 9).otherwise(F.col("channel")))):
        with pytest.raises(ValueError, match="not dense"):
            twod.SumThresholdFlagger(check_dense=True).get_flags(bad, (3, 4))
    filled = grids.densify(c.filter("channel <> 2").drop("flag"), {"time": 3, "channel": 4})
    assert twod.require_dense(filled, {"time": 3, "channel": 4}).filter("flag").count() == 6
    assert filled.filter("flag and value <> 0").count() == 0


def test_a_tuning_store_on_disk(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "device_name string, n int")
    assert sorted(map(tuple, tuning.save(f"{tmp_path}/s", rows(("a", 1), ("b", 2)), ["device_name"]).collect())) == [("a", 1), ("b", 2)]
    assert sorted(map(tuple, tuning.save(f"{tmp_path}/s", rows(("b", 5), ("c", 3)), ["device_name"]).collect())) == [("a", 1), ("b", 5), ("c", 3)]
    assert tuning.load(spark, f"{tmp_path}/s").count() == 3


def test_a_fold_of_many_columns(spark, monkeypatch):
    monkeypatch.setattr(reduce, "FOLDED", 7)
    grid = spark.range(300).selectExpr("cast(id % 3 as int) row", "cast(id as int) col", "id as value")
    got = reduce.hreduce(grid, lambda a, x: (a * 1 + x) % 1000, 0).collect()
    assert {r["row"]: r["value"] for r in got} == {k: sum(range(k, 300, 3)) % 1000 for k in range(3)}
    first = reduce.hreduce(grid, lambda a, x: F.when(a < 0, x).otherwise(a), -1)  # the first in column order
    assert {r["row"]: r["value"] for r in first.collect()} == {0: 0, 1: 1, 2: 2}


def test_a_kernel_of_ones_own(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [3.0, None]), (4, []), (5, [1.0, 2.0, 4.0]), (6, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "k int, values array<double>").coalesce(1)
    got = {r["k"]: r["last"] for r in kernel.kernel(df, lambda x: x[:, -1:] * 2 if x.shape[1] else x, out="last").collect()}
    assert {k: v for k, v in got.items() if k != 3} == {1: [4.0], 2: None, 4: [], 5: [8.0], 6: [10.0]}
    assert np.isnan(got[3][0])
    assert kernel.kernel(df, np.sort).columns == ["k", "values"]
    assert kernel.kernel(df.limit(0), np.sort).count() == 0
    with pytest.raises(Exception, match="the kernel made"):
        kernel.kernel(df, lambda x: x.sum(1)).collect()


def test_actions(spark):
    done = []
    with jobs.Actions(spark, threads=2, most=3) as actions:
        made = [actions.submit(lambda i=i: done.append(spark.range(10 + i).count())) for i in range(6)]
        assert len(actions.unfinished) <= 3
        actions.settle(1)
        assert len(actions.unfinished) <= 1
    assert all(f.done() for f in made)
    assert sorted(done) == [10, 11, 12, 13, 14, 15]
    order = []
    with jobs.Actions(spark, threads=1) as actions:
        for i in range(5):
            actions.submit(lambda i=i: order.append(i))
    assert order == list(range(5))
    actions = jobs.Actions(spark, 1)
    actions.submit(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        actions.settle()
    actions.settle()
    slow = actions.submit(lambda: spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L + id)").collect())
    late = actions.submit(lambda: "begun")
    time.sleep(1.5)
    actions.cancel()
    began = time.monotonic()
    assert slow.exception() is not None
    assert isinstance(late.exception(), InterruptedError)
    assert time.monotonic() - began < 15


def test_turns_and_deadlines(spark):
    async def run():
        shared, seen = jobs.InTurn("buffer"), []
        first, second, third = (shared.ask() for _ in range(3))

        async def use(number, name, fail=False):
            async with number as value:
                assert value == "buffer"
                seen.append(name)
                await asyncio.sleep(0.01)
                if fail:
                    raise RuntimeError(name)

        got = await asyncio.gather(use(third, 3), use(first, 1), use(second, 2, True), return_exceptions=True)
        with pytest.raises(TimeoutError):
            await jobs.wait_until(asyncio.sleep(5), time.monotonic() + 0.05)
        assert await jobs.wait_until(asyncio.sleep(0, "in time"), time.monotonic() + 5) == "in time"
        actions = jobs.Actions(spark, 2)
        assert await jobs.results([actions.submit(lambda: spark.range(3).count()), actions.submit(lambda: 5)]) == [3, 5]
        return seen, [type(x) for x in got]

    assert asyncio.run(run()) == ([1, 2], [RuntimeError, type(None), RuntimeError])
    assert jobs.best_setting(spark, "spark.sql.shuffle.partitions", ["2", "4"], lambda: spark.range(5).count()) in ("2", "4")


def test_stream(spark, tmp_path):
    r = np.random.default_rng(1)
    for k in range(2):
        v = r.normal(size=(40, 3))
        v[7, 1] = 90
        long(spark, v).withColumn("baseline", F.col("baseline") + 10 * k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("channel int, baseline int, value double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    flagger, seen = rfi.Flagger(rfi.MedianBackground(13, amplitudes=True), rfi.MadNoise(), rfi.SimpleThreshold(11.0)), []
    flag_stream(source, flagger, lambda df, n: seen.append((n, [(x["baseline"], x["channel"]) for x in df.filter("flag <> 0").collect()])), f"{tmp_path}/state").awaitTermination()
    assert sorted(x for _, rows in seen for x in rows) == [(1, 7), (11, 7)]
    assert [n for n, _ in seen] == [0, 1]
