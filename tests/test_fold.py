"""A user's fold against plain loops, and what it shuffles."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import fold
from gridloom.plans.compose import explained


def modular(a, b):
    return (a + b) % 997


def test_stretches_are_folded_pairwise():
    r = np.random.default_rng(1)
    for _ in range(30):
        length = r.integers(1, 20, r.integers(1, 30))
        values, starts = r.integers(0, 997, length.sum()), np.concatenate([[0], np.cumsum(length)])
        assert fold.folded(values, starts, modular).tolist() == [reduce(modular, values[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)]


@pytest.mark.parametrize("held", [3, 1 << 18])
def test_folds_equal_plain_loops(spark, held, monkeypatch):
    monkeypatch.setattr(fold, "HELD", held)
    r = np.random.default_rng(2)
    rows = [(f"r{i}" if i else None, j, None if r.random() < 0.1 else int(v)) for i in range(12) for j, v in enumerate(r.integers(0, 997, [1, 200, 3000][i % 3]))] + [("empty", 0, None)]
    grid = spark.createDataFrame(rows, "row string, col int, value long").repartition(7)
    want: dict = {}
    for row, _, v in rows:
        want[row] = modular(want.get(row, 0), v or 0)
    got = fold.fold(grid, modular, 0).collect()
    assert len(got) == len(want)
    assert {x["row"]: x["value"] for x in got} == want
    ranged = {x["row"]: x["value"] for x in fold.fold(grid, modular, 0, column_range=(1, 150)).collect()}
    assert ranged["r1"] == reduce(modular, [v or 0 for row, c, v in rows if row == "r1" and 1 <= c < 150])


def test_a_product_of_doubles_and_no_rows(spark):
    grid = spark.range(60).select((F.col("id") % 3).cast("int").alias("row"), F.col("id").cast("int").alias("col"), (1 + F.col("id") / 100).alias("value"))
    got = {x["row"]: x["value"] for x in fold.fold(grid, np.multiply, 1.0).collect()}
    assert all(abs(got[k] - np.prod([1 + i / 100 for i in range(k, 60, 3)])) < 1e-9 for k in range(3))
    assert fold.fold(grid.limit(0), np.multiply, 1.0).collect() == []
    with pytest.raises(ValueError, match="empty"):
        fold.fold(grid, np.multiply, 1.0, column_range=(4, 4))


def test_one_value_a_row_and_task_is_shuffled(spark):
    grid = spark.range(0, 20000, 1, 4).select((F.col("id") % 5).alias("row"), F.col("id").alias("col"), F.col("id").alias("value"))
    assert "collect_list" not in explained(fold.fold(grid, modular, 0))
    plan = fold.fold(grid, modular, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition") < plan.rindex("MapInArrow")
