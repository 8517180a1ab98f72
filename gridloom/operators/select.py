"""Exact selection by bisection of bit patterns: order statistics of groups of any size, without a sort and without gathering a group.

A double has a 64-bit key of the same order. A pass counts the values of every group by the next BITS bits of their keys, which partial
aggregation combines before the shuffle; the counts tell in which bucket each wanted rank lies and how many values come before it. Only buckets of more than
``limit`` values are divided again. What is left, ``limit`` values a bucket at most, is numbered in order; after 64 bits a bucket is one value
and needs no numbering. So a task holds counts of 2^BITS buckets or ``limit`` values, however large a group is and however often a value repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cluster import cut, free

#: Bits that a pass settles; values that are numbered together.
BITS, LIMIT = 16, 1 << 20
_HIDDEN = 52  # bits of a double's fraction


def ordered_key(value: Column) -> Column:
    """A long of the same order as the double: the bit pattern of its magnitude, negated for negative values. Both zeros are 0, NaN comes last."""
    size = F.abs(value.cast("double"))
    near = F.floor(F.log2(size)).cast("int")
    # The logarithm is rounded, so it may be off by one next to a power of two.
    power = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    fraction = (size / F.pow(F.lit(2.0), power) - 1) * float(1 << _HIDDEN)
    normal = (power + 1023).cast("long") * (1 << _HIDDEN) + fraction.cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    top = 2047 << _HIDDEN
    bits = F.when(F.isnan(size), top + 1).when(size == float("inf"), top).when(size == 0, 0).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when((value < 0) & ~F.isnan(value.cast("double")), -bits).otherwise(bits)


def with_key(rows: DataFrame, value: str, key: str = "_key") -> DataFrame:
    """``rows`` with ``ordered_key`` of ``value`` beside them, by a projection a step, so that each logarithm and power is worked out once a row: as one expression
    every branch repeats them. Rows of a null value are left out, by the value, as a filter of the key would repeat all steps."""
    size, unit, near = F.col("_size"), F.col("_unit"), F.col("_near")
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_size", F.abs(F.col(value).cast("double")))
    rows = rows.withColumn("_near", F.floor(F.log2(F.when(size < float("inf"), size))).cast("int")).withColumn("_unit", F.pow(F.lit(2.0), near))
    # The logarithm is rounded, so it may be off by one next to a power of two.
    rows = rows.withColumn("_off", F.when(unit > size, -1).when(unit * 2 <= size, 1).otherwise(0))
    right = F.when(F.col("_off") < 0, unit / 2).when(F.col("_off") > 0, unit * 2).otherwise(unit)
    normal = (near + F.col("_off") + 1023).cast("long") * (1 << _HIDDEN) + ((size / right - 1) * float(1 << _HIDDEN)).cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    top = 2047 << _HIDDEN
    bits = F.when(F.isnan(size), top + 1).when(size == float("inf"), top).when(size == 0, 0).when(size < 2.0**-1022, small).otherwise(normal)
    rows = rows.withColumn("_bits", bits)
    sign = (F.col(value) < 0) & ~F.isnan(F.col(value).cast("double"))
    return rows.withColumn(key, F.when(sign, -F.col("_bits")).otherwise(F.col("_bits"))).drop("_size", "_near", "_unit", "_off", "_bits")


def from_key(key: Column) -> Column:
    """The double of an ``ordered_key``."""
    bits = F.abs(key)
    power, fraction = F.shiftright(bits, _HIDDEN), bits.bitwiseAND((1 << _HIDDEN) - 1).cast("double")
    top = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
    size = F.when(power == 2047, top).when(power == 0, fraction * 5e-324).otherwise((fraction / float(1 << _HIDDEN) + 1) * F.pow(F.lit(2.0), (power - 1023).cast("double")))
    return F.when(key < 0, -size).otherwise(size)


def _same(names: Sequence[str], right: str = "_r_") -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(right + n)) for n in names])


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_r_{n}" for n in names})


def select(grid: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], limit: int = LIMIT) -> DataFrame:
    """(keys, count, name...): for each group the values at ``ranks``: name -> rank from 0 as a function of the number of values.

    Null values are left out, and a group without any has no row; a rank outside of the group gives null. Runs its passes at once: of each the driver sees
    the largest bucket. Two scans of ``grid`` where no bucket of the first pass holds more than ``limit`` values, four more at most.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    rows = with_key(grid.select(*keys, F.col(value).alias("_value")), "_value").select(*keys, "_key")
    shift, group = 64 - BITS, W.partitionBy(*keys)
    counts = kept(rows.groupBy(*keys, F.shiftright("_key", shift).alias("_prefix")).agg(F.count("*").alias("_k")), "histogram")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    totals = counts.withColumns({"_n": F.sum("_k").over(group), "_upto": F.sum("_k").over(group.orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0))})
    within = totals.select("*", F.explode(wanted).alias("_w")).filter((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_k")))
    # One row for each group and rank: the bucket's prefix, its number of values and the rank within it.
    state = within.select(*keys, F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_upto") + F.col("_k")).alias("_rank"), "_prefix", "_k")
    state, parts = kept(state, "ranks"), []
    while True:
        few = state.filter(F.col("_k") <= limit) if shift else state
        if shift:
            buckets = _renamed(few.select(*keys, "_prefix").distinct(), [*keys, "_prefix"])
            inside = rows.withColumn("_prefix", F.shiftright("_key", shift)).join(buckets, _same([*keys, "_prefix"])).select(*keys, "_prefix", "_key")
            numbered = inside.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_prefix").orderBy("_key")) - 1)
            picked = _renamed(few, [*keys, "_prefix"]).join(numbered, _same([*keys, "_prefix"]) & (F.col("_at") == F.col("_rank")))
            parts.append(picked.select(*keys, "_name", from_key(F.col("_key")).alias("_v")))
        else:
            parts.append(few.select(*keys, "_name", from_key(F.col("_prefix")).alias("_v")))
            break
        many = state.filter(F.col("_k") > limit)
        if many.isEmpty():
            break
        # Buckets that are too large are divided by their next bits.
        buckets = _renamed(many.select(*keys, "_prefix").distinct(), [*keys, "_prefix"])
        inside = rows.withColumn("_prefix", F.shiftright("_key", shift)).join(buckets, _same([*keys, "_prefix"]))
        shift -= BITS
        counts = inside.groupBy(*keys, "_prefix", F.shiftright("_key", shift).alias("_next")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(W.partitionBy(*keys, "_prefix").orderBy("_next").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto)
        found = _renamed(many, [*keys, "_prefix"]).join(counts, _same([*keys, "_prefix"]) & (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        state = kept(found.select(*keys, "_name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.col("_next").alias("_prefix"), F.col("_c").alias("_k")), "ranks")
    picked = reduce(DataFrame.unionByName, parts)
    sizes = made[0].groupBy(*keys).agg(F.sum("_k").alias("count"))
    values = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    out = cut(sizes.join(_renamed(values, keys), _same(keys), "left").select(*keys, "count", *ranks), "selected")
    free(*made)
    return out


def medians(grid: DataFrame, keys: Sequence[str], value: str, limit: int = LIMIT, out: str = "value") -> DataFrame:
    """(keys, out): the interpolating median of each group's values, as ``functions.median`` has it."""
    two = select(grid, keys, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)}, limit)
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * 0.5 + F.col("_high") * 0.5)
    return two.select(*keys, middle.alias(out))
