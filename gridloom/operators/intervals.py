"""Samples to the intervals that hold them, where intervals are a table: a join by buckets of several widths.

An interval stands in the buckets it touches, of the widest width of 1, BASE, BASE^2, ... that is not longer than itself, so in BASE + 1 of them at most; a sample stands in one bucket of each
width that any interval has. They meet by equality of width and bucket, a hash or merge join that Spark can spread and split, and the bounds decide. Neither very
uneven nor overlapping intervals make it a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 16


def locate(samples: DataFrame, intervals: DataFrame, axis: str, low: str = "low", high: str = "high", keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """``samples`` with the columns of each interval [low, high) that holds ``axis``: a row for each pair; ``how`` "left" also keeps samples in none, once, with nulls.

    ``keys`` must be equal on both sides. ``axis`` and bounds are whole numbers; null samples are in no interval, null, empty and reversed intervals hold none. Columns other than the
    keys must have different names. One small aggregation over ``intervals`` runs at once, to know which widths there are.
    """
    if clash := (set(samples.columns) & set(intervals.columns)) - set(keys):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    if how not in ("inner", "left"):
        raise ValueError(f"no join {how!r}")
    length = F.col(high).cast("long") - F.col(low)
    level = F.lit(0)
    for k in range(1, 16):
        level = level + F.when(length >= BASE**k, 1).otherwise(0)
    real = intervals.filter(length > 0).withColumn("_level", level)
    levels = sorted(r["_level"] for r in real.select("_level").distinct().collect())
    width = F.element_at(F.array(*[F.lit(BASE**k) for k in range(16)]), F.col("_level") + 1)
    bucket = lambda x, w: F.floor(F.col(x) / w).cast("long")
    first, last = F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)
    placed = real.withColumn("_bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    spots = F.array(*[F.struct(F.lit(k).alias("l"), bucket(axis, BASE**k).alias("b")) for k in levels]) if levels else F.array().cast("array<struct<l: int, b: bigint>>")
    spread = samples.withColumn("_s", F.explode(spots)).withColumns({"_l": F.col("_s.l"), "_b": F.col("_s.b")}).drop("_s")
    on = (F.col("_l") == F.col("_level")) & (F.col("_b") == F.col("_bucket")) & (F.col(axis) >= F.col(low)) & (F.col(axis) < F.col(high))
    right = placed
    for k in keys:
        right = right.withColumnRenamed(k, f"_key_{k}")
        on = on & (F.col(k) == F.col(f"_key_{k}"))
    out = [*samples.columns, *(c for c in intervals.columns if c not in keys)]
    found = spread.join(right, on)
    if how == "inner":
        return found.select(*out)
    # Samples of equal keys and place are in the same intervals.
    without = samples.join(found.select(*keys, axis).distinct(), [*keys, axis], "left_anti")
    return found.select(*out).unionByName(without, allowMissingColumns=True)
