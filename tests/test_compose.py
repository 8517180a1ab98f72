"""Compounds and nested sequences, indexing of axes, settings that are measured once."""

import numpy as np
import pytest

from gridloom import schema
from gridloom.operators import basic, reduce
from gridloom.plans import compose, jobs
from gridloom.sources import grids, store_writer
from tests.test_grids import as_rows, long

SLOT = schema.Slot({"row": "integer", "col": "integer", "value": "number"})
SCALE = compose.Operation("scale", lambda src: basic.scale(src, 2.0), {"src": SLOT})
TOTAL = compose.Operation("sum", lambda src: reduce.hreduce(src, "sum"), {"src": SLOT})
MOST = compose.Operation("most", lambda src: reduce.hreduce(src, "max"), {"src": schema.Slot({"row": "any", "value": "number"})})


def test_a_compound_is_one_table(spark):
    grid = long(spark, np.arange(12.0).reshape(4, 3), ("row", "col"))
    both = compose.Sequence((SCALE, TOTAL, MOST), compounds={"data": ("scale.src", "most.src"), "scaled": ("scale.out", "sum.src")})
    assert list(both.inputs) == ["data"]
    assert both.inputs["data"].columns == SLOT.columns
    got = both(data=grid)
    assert as_rows(got["sum.out"], ("row",)) == [6, 24, 42, 60]
    assert as_rows(got["most.out"], ("row",)) == [2, 5, 8, 11]
    assert both.outputs == ("scaled", "sum.out", "most.out")
    for bad in ({"a": ("scale.src",), "b": ("scale.src",)}, {"a": ("scale.src", "scale.src")}, {"a": ("scale.nothing",)}):
        with pytest.raises(ValueError):
            compose.Sequence((SCALE, TOTAL), compounds=bad)
    with pytest.raises(ValueError, match="two compounds"):
        compose.Sequence((SCALE, TOTAL), {"scale.src": "x"}, {"a": ("scale.src",)})
    words = compose.Operation("words", lambda src: src, {"src": schema.Slot({"value": "boolean"})})
    with pytest.raises(TypeError, match="both"):
        compose.Sequence((SCALE, words), compounds={"data": ("scale.src", "words.src")})


def test_a_sequence_is_an_operation_of_another(spark):
    grid = long(spark, np.arange(12.0).reshape(4, 3), ("row", "col"))
    inner = compose.Sequence((SCALE, TOTAL), {"scale.src": "in", "scale.out": "mid", "sum.src": "mid", "sum.out": "done"}, name="inner")
    outer = compose.Sequence((inner, MOST), compounds={"grid": ("inner.in",), "scaled": ("inner.mid", "most.src"), "sums": ("inner.done",)})
    assert list(outer.inputs) == ["grid"]
    got = outer(grid=grid)
    assert as_rows(got["sums"], ("row",)) == [6, 24, 42, 60]
    assert as_rows(got["most.out"], ("row",)) == [4, 10, 16, 22]
    assert '"inner" -> "scaled"' in outer.graph()


def test_integer_indices_drop_axes_and_none_makes_one(spark):
    a, shape = np.arange(63).reshape(7, 9), {"row": 7, "col": 9}
    grid = long(spark, a, ("row", "col"))
    row = basic.region(grid, {"row": -2, "col": (1, 8, 3), "pol": None}, shape, squeeze=True)
    assert sorted(row.columns) == ["col", "pol", "value"]
    assert (grids.to_array(row, ("pol", "col")) == a[None, -2, 1:8:3]).all()
    assert sorted(basic.region(grid, {"row": 3}, shape).columns) == ["col", "row", "value"]
    with pytest.raises(IndexError, match="no new axis"):
        basic.region(grid, {"row": None}, shape)
    with pytest.raises(IndexError, match="no axis"):
        basic.region(grid, {"pol": 0}, shape)


def test_a_setting_is_measured_once(spark, tmp_path):
    at, ran = str(tmp_path / "store"), []
    key, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")

    def action():
        ran.append(spark.conf.get(key))

    got = jobs.tuned_setting(spark, at, "sum", {"rows": 5}, key, ["2", "3"], action)
    assert got in ("2", "3")
    assert ran == ["2", "3"]
    assert jobs.tuned_setting(spark, at, "sum", {"rows": 5}, key, ["2", "3"], action) == got
    assert len(ran) == 2
    jobs.tuned_setting(spark, at, "sum", {"rows": 6}, key, ["2"], action)
    assert ran == ["2", "3", "2"]
    assert store_writer.latest(at) == 1
    assert spark.conf.get(key) == old
