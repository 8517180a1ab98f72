"""The .npy data source: headers, boxes, reads, filters, and a write that appears whole or not at all."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import npy_source as npy


def arrays():
    r = np.random.default_rng(1)
    z = (r.normal(0, 1, (5, 7, 3)) + 1j * r.normal(0, 1, (5, 7, 3))).astype(np.complex64)
    return {"c": z, "f": np.asfortranarray(r.normal(0, 1, (4, 6, 2))), "i": r.integers(-9, 9, (3, 3, 3)).astype(">i2"), "b": r.random((2, 5, 2)) < 0.5, "e": np.zeros((0, 4, 2)), "one": np.full((1, 1, 1), 2.5)}


@pytest.mark.parametrize("part", [64, 1 << 20])
def test_every_sample_is_read_once(spark, tmp_path, part):
    for name, a in arrays().items():
        np.save(tmp_path / f"{name}.npy", a)
    (tmp_path / "notes.txt").write_text("no array")
    got = {(os.path.basename(x["file"])[:-4], x["time"], x["channel"], x["baseline"]): complex(x["re"], x["im"]) for x in npy.scan_npy(spark, str(tmp_path), part=part).collect()}
    assert got == {(name, *at): complex(v) for name, a in arrays().items() for at, v in np.ndenumerate(a)}


def test_ranges_read_only_their_bytes():
    a = npy.Header(128, (1000, 4096, 50), np.dtype("complex64"), False)
    whole = list(npy.boxes("x", a, [(0, 1000), (0, 4096), (0, 50)], 128 << 20))
    assert len(whole) > 10
    assert sum(b - a for box in whole for a, b in [box.ranges[0]]) == 1000
    some = list(npy.boxes("x", a, [(0, 1000), (100, 200), (0, 50)], 128 << 20))
    assert len(some) == 1
    reads = list(npy.spans(some[0]))
    assert sum(size for _, _, size in reads) == 1000 * 100 * 50 * 8
    assert max(size for _, _, size in reads) <= npy.READ
    assert reads[0][1] == 128 + 100 * 50 * 8
    # one time of many bytes is divided along channel
    wide = list(npy.boxes("x", npy.Header(80, (1, 1 << 20, 1 << 10), np.dtype("float64"), False), [(0, 1), (0, 1 << 20), (0, 1 << 10)], 128 << 20))
    assert len(wide) == 64
    assert {box.ranges[0] for box in wide} == {(0, 1)}


def test_where_and_filters_narrow_the_scan(spark, tmp_path):
    a = arrays()["c"]
    np.save(tmp_path / "c.npy", a)
    rows = npy.scan_npy(spark, str(tmp_path / "c.npy"), where={"channel": (2, 5), "baseline": (1, 9)}).collect()
    assert {(x["time"], x["channel"], x["baseline"]) for x in rows} == {(t, c, b) for t in range(5) for c in range(2, 5) for b in (1, 2)}
    reader = npy.NpyReader({"path": str(tmp_path)}, ["time", "channel", "baseline"])
    left = list(reader.pushFilters([npy.ds.GreaterThan(("channel",), 2), npy.ds.LessThanOrEqual(("channel",), 4), npy.ds.EqualTo(("time",), 3), npy.ds.LessThan(("re",), 0), npy.ds.GreaterThanOrEqual(("baseline",), 1), npy.ds.LessThan(("baseline",), 2)]))
    assert [type(f).__name__ for f in left] == ["LessThan"]
    assert reader.ranges == {"time": (3, 4), "channel": (3, 5), "baseline": (1, 2)}
    pushed = npy.scan_npy(spark, str(tmp_path)).filter("channel >= 2 and channel < 5 and time = 1 and re > 0")
    assert {(x["channel"], x["baseline"]) for x in pushed.collect()} == {(c, b) for c in range(2, 5) for b in range(3) if a[1, c, b].real > 0}


def test_errors(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 2)))
    np.save(tmp_path / "o.npy", np.array([["x"]]))
    (tmp_path / "t.txt").write_text("x")
    for path, said in ((tmp_path / "a.npy", "axes"), (tmp_path / "o.npy", "no number"), (tmp_path / "t.txt", "only .npy"), (tmp_path / "none.npy", "none.npy")):
        with pytest.raises(Exception, match=said):
            npy.scan_npy(spark, str(path), ("x", "y", "z") if said == "axes" else ("x", "y")).collect()
    with pytest.raises(ValueError, match="no axes"):
        npy.scan_npy(spark, str(tmp_path), ("x", "y"), {"z": (0, 1)})


def test_a_write_appears_whole_or_not_at_all(spark, tmp_path):
    npy.register(spark)
    at = str(tmp_path / "out")
    rows = spark.range(40).select(F.array(*[(F.col("id") * 10 + k).cast("double") for k in range(3)]).alias("values"))
    rows.repartition(4).write.format("npy").mode("append").save(at)
    read = npy.scan_npy(spark, at, ("row", "col"))
    assert sorted(x["re"] for x in read.collect()) == sorted(float(i * 10 + k) for i in range(40) for k in range(3))
    before = sorted(os.listdir(at))
    assert len(before) == 4
    broken = rows.withColumn("values", F.when(F.col("values")[0] == 390, F.array(F.lit(1.0))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="one length"):
        broken.repartition(4).write.format("npy").mode("append").save(at)
    assert sorted(os.listdir(at)) == before
    rows.limit(1).write.format("npy").mode("overwrite").save(at)
    assert [np.load(p).tolist() for p in glob.glob(f"{at}/*.npy")] == [[[0.0, 1.0, 2.0]]]
    with pytest.raises(Exception, match="one column"):
        spark.range(1).write.format("npy").mode("append").save(at)
