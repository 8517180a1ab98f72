"""Reductions of rows and columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import amplitude
from gridloom.operators import select

#: Columns that a user's fold takes at a time.
FOLDED = 4096
#: Ranges of values that ``ranks`` puts in order apart.
RANGES = 64
OPERATIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor, "all": F.bool_and, "any": F.bool_or, "count": F.count,
}


def _in_range(grid: DataFrame, columns: str, column_range: tuple[int, int] | None, size: int | None) -> DataFrame:
    if column_range is None:
        return grid
    low, high = column_range
    if low < 0 or (size is not None and high > size):
        raise IndexError(f"[{low}, {high}) is out of range")
    if low >= high:
        raise ValueError(f"[{low}, {high}) is empty")
    return grid.filter((F.col(columns) >= low) & (F.col(columns) < high))


def hreduce(
    grid: DataFrame, op: str | Callable[[Column, Column], Column], identity=None, rows: str = "row", columns: str = "col", value: str = "value",
    column_range: tuple[int, int] | None = None, size: int | None = None,
) -> DataFrame:
    """(row, value): each row folded over [start, stop) of its columns.

    ``op`` is a name of OPERATIONS, which is combined before the shuffle, or a function of two columns, commutative and
    associative, that starts from ``identity``; runs of FOLDED columns are gathered and folded in column order, then their results.
    """
    part = _in_range(grid, columns, column_range, size)
    if isinstance(op, str):
        return part.groupBy(rows).agg(OPERATIONS[op](F.col(value)).alias(value))
    if identity is None:
        raise ValueError("a function needs its identity")
    kind = grid.schema[value].dataType

    def folded(at: str, held: str) -> Column:
        in_order = F.transform(F.sort_array(F.collect_list(F.struct(F.col(at), F.col(held).alias("_v")))), lambda x: x["_v"])
        return F.aggregate(in_order, F.lit(identity).cast(kind), lambda a, x: op(a, x).cast(kind))

    # Runs of columns first, so that no array is longer than a run or than the number of runs.
    runs = part.withColumn("_run", F.floor(F.col(columns) / FOLDED).cast("long")).groupBy(rows, "_run").agg(folded(columns, value).alias("_part"))
    return runs.groupBy(rows).agg(folded("_run", "_part").alias(value))


def block_sum(series: DataFrame, block: int = 128, index: str = "i", value: str = "value", whole: bool = True) -> DataFrame:
    """(block, value): sums of ``block`` consecutive samples. If ``whole``, a block of another number of samples fails the job."""
    total = F.sum(value)
    if whole:
        total = F.when(F.count(F.lit(1)) == block, total).otherwise(F.raise_error(F.lit(f"the length is no multiple of {block}")))
    return series.groupBy(F.floor(F.col(index) / block).cast("long").alias("block")).agg(total.alias(value))


def masked_sum(grid: DataFrame, mask: DataFrame, rows: str = "row", columns: str = "col", amplitudes: bool = False) -> DataFrame:
    """Column sums weighted by a value a row (``mask``: row, mask): re and im, or of amplitudes as ``value``.

    Rows without a mask weigh nothing. The planner broadcasts the mask if it is small enough; sums are combined before the shuffle.
    """
    joined = grid.join(mask.select(rows, F.col("mask").cast("double").alias("_mask")), rows)
    if amplitudes:
        size = amplitude(F.col("re"), F.col("im")) if "re" in grid.columns else amplitude(F.col("value"))
        return joined.groupBy(columns).agg(F.sum(F.col("_mask") * size).alias("value"))
    return joined.groupBy(columns).agg(F.sum(F.col("_mask") * F.col("re")).alias("re"), F.sum(F.col("_mask") * F.col("im")).alias("im"))


def _bisects(method: str | None, size: int | None) -> bool:
    if method not in (None, "sort", "bisect"):
        raise ValueError(f"no method {method!r}")
    return method == "bisect" or (method is None and size is not None and size > select.LIMIT)


def percentile5(
    grid: DataFrame, rows: str = "row", columns: str = "col", column_range: tuple[int, int] | None = None, size: int | None = None, max_columns: int | None = None, method: str | None = None,
) -> DataFrame:
    """(row, min, max, q25, q75, q50) of the amplitudes: lower order statistics, at ranks (n - 1) * k // 4 from 0.

    ``method`` "sort" ranks values by an external sort within each row, "bisect" counts bits of their keys (``select``) and never brings a row together;
    unless given, rows of more than ``select.LIMIT`` columns by ``size`` or ``column_range`` are bisected.
    """
    if column_range is not None and max_columns is not None and column_range[1] - column_range[0] > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    part = _in_range(grid, columns, column_range, size)
    size_of = amplitude(F.col("re"), F.col("im")) if "re" in grid.columns else F.col("value").cast("double")
    part = part.select(rows, size_of.alias("_v")).filter("_v is not null")
    if _bisects(method, size if column_range is None else column_range[1] - column_range[0]):
        at = {name: (lambda n, k=k: F.floor((n - 1) * k / 4)) for name, k in (("min", 0), ("max", 4), ("q25", 1), ("q75", 3), ("q50", 2))}
        return select.select(part, [rows], "_v", at).drop("count")
    ranked = part.withColumns({"_at": F.row_number().over(W.partitionBy(rows).orderBy("_v")) - 1, "_n": F.count("*").over(W.partitionBy(rows))})
    pick = lambda k: F.max(F.when(F.col("_at") == F.floor((F.col("_n") - 1) * k / 4), F.col("_v")))
    return ranked.groupBy(rows).agg(pick(0).alias("min"), pick(4).alias("max"), pick(1).alias("q25"), pick(3).alias("q75"), pick(2).alias("q50"))


def order_statistic(grid: DataFrame, rank: int, rows: str = "row", value: str = "value", halfway: bool = False, size: int | None = None, method: str | None = None) -> DataFrame:
    """(row, value): the value at ``rank`` from 0; if ``halfway``, the mean of it and the one before. ``size`` and ``method`` as for ``percentile5``; bisection knows doubles."""
    low = rank - 1 if halfway else rank
    if _bisects(method, size):
        two = select.select(grid, [rows], value, {"_low": lambda n: F.lit(max(low, 0)), "_high": lambda n: F.lit(rank)})
        first, last = F.coalesce("_low", "_high"), F.coalesce("_high", "_low")
        return two.filter("_low is not null").select(rows, ((first + last) / 2 if halfway and low >= 0 else last).alias(value))
    ranked = grid.filter(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(W.partitionBy(rows).orderBy(value)) - 1)
    return ranked.filter(F.col("_at").between(low, rank)).groupBy(rows).agg(F.avg(value).alias(value))


def ranks(values: DataFrame, points: DataFrame, value: str = "value", point: str = "point") -> DataFrame:
    """(point, below): for each point how many values are less, by one pass over both in order of value.

    Values are counted by value first. The order is made by ranges of about as many values: counts are summed within a range and then added to
    what all ranges before it hold, so no task sees all values.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_k"))
    marks = points.select(F.col(point).cast("double").alias("_x")).distinct()
    both = counts.select("_x", "_k", F.lit(1).alias("_last")).unionByName(marks.select("_x", F.lit(0).cast("long").alias("_k"), F.lit(0).alias("_last")))
    # Ranges hold about as many distinct values each, however these are spread.
    bounds = both.agg(F.percentile_approx("_x", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("b")).first()["b"] or []
    at = F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]).cast("array<double>")
    both = both.withColumn("_range", F.size(F.filter(at, lambda x: x <= F.col("_x"))))
    totals = both.groupBy("_range").agg(F.sum("_k").alias("_all"))
    before = totals.select("_range", F.coalesce(F.sum("_all").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy("_x", "_last").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = both.withColumn("_here", F.sum("_k").over(inside)).filter("_last = 0")
    return summed.join(before, "_range").select(F.col("_x").alias(point), (F.col("_here") + F.col("_before")).alias("below"))
