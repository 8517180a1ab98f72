"""Transposed arrays against NumPy."""

import numpy as np
import pytest

from gridloom import schema
from gridloom.operators import vectors
from gridloom.plans.compose import explained
from tests.test_grids import long


@pytest.mark.parametrize("channels", [3, 64])
def test_arrays_by_baseline_become_arrays_by_channel(spark, channels, monkeypatch):
    monkeypatch.setattr(vectors, "SERIES", 4)
    data = np.random.default_rng(1).normal(0, 1, (10, 13))
    rows = [(i * 3 - 5, [None if (i, j) == (2, 4) else float("nan") if (i, j) == (3, 3) else float(data[i, j]) for j in range(13)]) for i in range(10)]
    given = spark.createDataFrame(rows, "baseline int, values array<double>").repartition(3)
    got = {x["channel"]: x for x in vectors.transpose_vectors(given, channels=channels).collect()}
    assert sorted(got) == list(range(13))
    for j, x in got.items():
        assert x["keys"] == [i for i, _ in rows]
        assert [str(v) for v in x["values"]] == [str(v[j]) for _, v in rows]
    back = vectors.transpose_vectors(vectors.transpose_vectors(given, channels=channels), "channel", axis="baseline", channels=channels)
    assert [[str(v) for v in x["values"]] for x in sorted(back.collect(), key=lambda x: x["baseline"])] == [[str(v) for v in v_] for _, v_ in rows]


def test_short_and_missing_arrays(spark):
    given = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, []), (4, [4.0])], "baseline long, values array<double>").repartition(3)
    got = {x["channel"]: (x["keys"], x["values"]) for x in vectors.transpose_vectors(given, channels=2).collect()}
    assert got == {0: ([1, 2, 3, 4], [1.0, None, None, 4.0]), 1: ([1, 2, 3, 4], [2.0, None, None, None]), 2: ([1, 2, 3, 4], [3.0, None, None, None])}
    assert vectors.transpose_vectors(given.limit(0)).collect() == []


def test_one_shuffle_and_no_explosion(spark):
    grid = long(spark, np.random.default_rng(2).normal(0, 1, (6, 5)))
    plan = explained(vectors.transpose_vectors(schema.to_vectors(grid).repartition(3)))
    after = plan[: plan.index("MapInArrow")]
    assert "Generate" not in after
    assert after.count("Exchange (") == 1
