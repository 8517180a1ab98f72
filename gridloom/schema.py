"""Grid layouts and the checks on them.

LONG: one row a sample, keyed by its indices (``baseline``, ``channel`` and, in cubes, ``time``), values in ``value`` or
``re``/``im``, flags in ``flag``. VECTOR: one row a baseline with ``values``, an array in channel order. A missing or
flagged sample is NULL inside aggregates; NaN becomes NULL on the way in, as comparisons with NaN are true in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "boolean": (T.BooleanType,),
    "flag": (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "vector": (T.ArrayType,),
    "any": (T.DataType,),
}


class Slot:
    """What an operation expects of one table: column -> kind."""

    def __init__(self, columns: Mapping[str, str]):
        if unknown := set(columns.values()) - set(KINDS):
            raise ValueError(f"unknown kinds {sorted(unknown)}")
        self.columns = dict(columns)

    def validate(self, df: DataFrame, name: str = "input") -> DataFrame:
        """``df``; a missing column is a ValueError, one of another kind a TypeError."""
        have = {f.name: f.dataType for f in df.schema.fields}
        for column, kind in self.columns.items():
            if column not in have:
                raise ValueError(f"{name} has no column {column!r}")
            if not isinstance(have[column], KINDS[kind]):
                raise TypeError(f"{name}.{column} is {have[column].simpleString()}, not {kind}")
        return df


GRID2 = Slot({"baseline": "any", "channel": "integer", "value": "number"})
COMPLEX2 = Slot({"baseline": "any", "channel": "integer", "re": "number", "im": "number"})
GRID3 = Slot({"baseline": "any", "time": "integer", "channel": "integer", "value": "number", "flag": "flag"})


def with_boolean(grid: DataFrame, column: str = "flag") -> DataFrame:
    """``grid`` with a flag of any width as a boolean: any value but zero flags."""
    kind = grid.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return grid
    if not isinstance(kind, KINDS["flag"]):
        raise TypeError(f"{column} is {kind.simpleString()}, not a flag")
    return grid.withColumn(column, F.col(column) != 0)


def narrowest(value: int) -> T.DataType:
    """The narrowest integer type that holds ``value``."""
    for kind, bits in ((T.ByteType(), 8), (T.ShortType(), 16), (T.IntegerType(), 32), (T.LongType(), 64)):
        if -(1 << (bits - 1)) <= value < 1 << (bits - 1):
            return kind
    raise OverflowError(f"{value} is beyond 64 bits")


def finite(value: Column) -> Column:
    """``value`` as double, NaN as NULL."""
    as_double = value.cast("double")
    return F.when(~F.isnan(as_double), as_double)


def to_vectors(grid: DataFrame, key: str = "baseline", axis: str = "channel", value: str = "value") -> DataFrame:
    """LONG to VECTOR; null values keep their place."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(axis), F.col(value).alias("_v"))))
    return grid.groupBy(key).agg(F.transform(pairs, lambda x: x["_v"]).alias("values"))


def to_long(vectors: DataFrame, key: str = "baseline", axis: str = "channel", value: str = "value") -> DataFrame:
    """VECTOR to LONG, counting from 0."""
    return vectors.select(key, F.posexplode("values").alias(axis, value))
