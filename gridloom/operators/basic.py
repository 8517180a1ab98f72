"""Fill, scale, transpose, regions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fill(spark: SparkSession, shape: Mapping[str, int], value=0) -> DataFrame:
    """A grid of the given axes (name -> size), every sample ``value``; rows are generated, not joined."""
    if not shape or min(shape.values()) < 0:
        raise ValueError("a grid has axes, and their sizes are not negative")
    total = 1
    for n in shape.values():
        total *= n
    below, columns = total, []
    for name, n in shape.items():
        below //= max(n, 1)
        columns.append((F.floor(F.col("id") / max(below, 1)) % max(n, 1)).cast("int").alias(name))
    return spark.range(total).select(*columns, F.lit(value).alias("value"))


def fill_like(grid: DataFrame, value=0, column: str = "value") -> DataFrame:
    return grid.withColumn(column, F.lit(value).cast(grid.schema[column].dataType))


def zero(grid: DataFrame, column: str = "value") -> DataFrame:
    return fill_like(grid, 0, column)


def scale(grid: DataFrame, factor: float, column: str = "value") -> DataFrame:
    return grid.withColumn(column, F.col(column) * F.lit(factor))


def transpose(grid: DataFrame, rows: str = "row", columns: str = "col") -> DataFrame:
    """The two index columns change places: no data moves."""
    swap = {rows: columns, columns: rows}
    return grid.select(*[F.col(c).alias(swap.get(c, c)) for c in grid.columns])


Region = Mapping[str, "int | slice | tuple[int, int] | tuple[int, int, int] | None"]


def canonical(region: Region, shape: Mapping[str, int]) -> dict[str, tuple[int, int, int]]:
    """(start, stop, step) for every axis of ``shape``. IndexError: unknown axis, out of range, empty or a step that is not
    positive; TypeError: not an integer, slice or tuple. A slice's length rounds up, as in NumPy. An axis that ``shape`` lacks, given as None, is a new one, and not in the result."""
    out = {}
    for axis, at in region.items():
        if axis not in shape and at is not None:
            raise IndexError(f"no axis {axis!r}")
        if axis in shape and at is None:
            raise IndexError(f"{axis!r} is no new axis")
    for axis, n in shape.items():
        at = region.get(axis, slice(None))
        if isinstance(at, bool) or not isinstance(at, int | slice | tuple):
            raise TypeError(f"{axis}: {type(at).__name__} is not an index")
        if isinstance(at, int):
            low = at + n if at < 0 else at
            high, step = low + 1, 1
        else:
            at = slice(*at) if isinstance(at, tuple) else at
            step = 1 if at.step is None else at.step
            low = 0 if at.start is None else at.start + n if at.start < 0 else at.start
            high = n if at.stop is None else at.stop + n if at.stop < 0 else at.stop
        if step <= 0:
            raise IndexError(f"{axis}: the step must be positive")
        if low < 0 or high > n or low >= high:
            raise IndexError(f"{axis}: [{low}, {high}) is empty or out of range")
        out[axis] = (low, high, step)
    return out


def region(grid: DataFrame, where: Region, shape: Mapping[str, int], reindex: bool = True, squeeze: bool = False) -> DataFrame:
    """The samples of a strided rectangle, counted from 0 if ``reindex``. Bounds are plain range predicates, which reach the scan. An axis of ``where`` that is None is new and has
    one place, 0; if ``squeeze``, axes given as an integer are dropped, as indexing an array does."""
    out = grid
    for axis, (low, high, step) in canonical(where, shape).items():
        if (low, high) != (0, shape[axis]):
            out = out.filter((F.col(axis) >= low) & (F.col(axis) < high))
        if step > 1:
            out = out.filter((F.col(axis) - low) % step == 0)
        if reindex and (low or step > 1):
            out = out.withColumn(axis, F.floor((F.col(axis) - low) / step).cast(grid.schema[axis].dataType))
    new = {axis: F.lit(0) for axis, at in where.items() if at is None}
    gone = [axis for axis, at in where.items() if squeeze and isinstance(at, int)]
    return out.withColumns(new).drop(*gone) if new or gone else out


def region_write(dest: DataFrame, src: DataFrame, where: Region, shape: Mapping[str, int], column: str = "value") -> DataFrame:
    """``dest`` with the rectangle's samples taken from ``src``, which counts from 0; samples that ``src`` lacks stay."""
    if dest.schema[column].dataType != src.schema[column].dataType:
        raise TypeError(f"{src.schema[column].dataType.simpleString()} does not go into {dest.schema[column].dataType.simpleString()}")
    axes = list(shape)
    placed, inside = src, F.lit(True)
    for axis, (low, high, step) in canonical(where, shape).items():
        placed = placed.withColumn(axis, (F.col(axis) * step + low).cast(dest.schema[axis].dataType))
        inside = inside & (F.col(axis) < high)
    placed = placed.filter(inside).select(*axes, F.col(column).alias("_new"), F.lit(True).alias("_given"))
    joined = dest.join(placed, axes, "left")
    return joined.withColumn(column, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(column))).select(dest.columns)


def region_copy(dest: DataFrame, src: DataFrame, src_region: Region, dest_region: Region, src_shape: Mapping[str, int], dest_shape: Mapping[str, int], column: str = "value") -> DataFrame:
    """Copies a rectangle of ``src`` into one of ``dest``; sizes that differ are a ValueError."""
    sizes = [[-(-(high - low) // step) for low, high, step in canonical(r, s).values()] for r, s in ((src_region, src_shape), (dest_region, dest_shape))]
    if sizes[0] != sizes[1]:
        raise ValueError(f"the regions have sizes {sizes[0]} and {sizes[1]}")
    return region_write(dest, region(src, src_region, src_shape), dest_region, dest_shape, column)
