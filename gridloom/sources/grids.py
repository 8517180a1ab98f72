"""Grids from driver tables, arrays and generators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the events grid: first day, days, half hours a day.
FIRST_DAY, DAYS, SLOTS = 1_704_067_200, 30, 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(baseline, channel, value): one series for each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.posexplode("embedding").alias("channel", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


def emb_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(baseline, channel, re, im): pairs of neighbouring embedding entries."""
    e = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), (F.size(e) / 2).cast("int") - 1), lambda i: F.struct(F.get(e, (2 * i).cast("int")).cast("double").alias("re"), F.get(e, (2 * i + 1).cast("int")).cast("double").alias("im")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.posexplode(pairs).alias("channel", "z"))
    return rows.select("baseline", "channel", "z.re", "z.im")


def ev3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(baseline, time, channel, value, flag): mean event value by type, day and half hour; empty cells are flagged."""
    at = F.unix_timestamp("ts") - FIRST_DAY
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("baseline"), F.floor(at / 86_400).cast("int").alias("time"), F.floor((at % 86_400) / 1800).cast("int").alias("channel"), "value"
    )
    cells = rows.groupBy("baseline", "time", "channel").agg(F.avg("value").alias("_mean"))
    return densify(cells.withColumnRenamed("_mean", "value"), {"time": DAYS, "channel": SLOTS})


def densify(cells: DataFrame, axes: dict[str, int], keys: tuple[str, ...] = ("baseline",), value: str = "value", default: float = 0.0) -> DataFrame:
    """(keys, axes, value, flag): a row for each cell of ``axes`` (name -> size) of each group of ``keys``; cells without a value hold
    ``default`` and are flagged. Groups come from the cells, the rest is generated beside each, without a cross join."""
    every = cells.select(*keys).distinct()
    for name, size in axes.items():
        every = every.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    dense = every.join(cells.select(*keys, *axes, F.col(value).alias("_v")), [*keys, *axes], "left")
    return dense.select(*keys, *axes, F.coalesce("_v", F.lit(default)).alias(value), F.col("_v").isNull().alias("flag"))


def li2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, value): revenue by shipping month and line state."""
    li = table(spark, sf_dir, "lineitem")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1).cast("int")
    return li.groupBy(month.alias("row"), F.concat("l_returnflag", "l_linestatus").alias("col")).agg(F.sum("l_extendedprice").alias("value"))


def from_array(spark: SparkSession, array: np.ndarray, axes: tuple[str, ...] = ("channel", "baseline")) -> DataFrame:
    """A NumPy array as a LONG grid: the given index columns, then ``value`` or ``re`` and ``im``."""
    array = np.asarray(array)
    if array.ndim != len(axes):
        raise ValueError(f"the array has {array.ndim} axes, not {len(axes)}")
    import pandas as pd

    index = np.indices(array.shape).reshape(array.ndim, -1)
    data = {name: index[k].astype(np.int32) for k, name in enumerate(axes)}
    flat = array.reshape(-1)
    fields = [T.StructField(name, T.IntegerType(), False) for name in axes]
    if np.iscomplexobj(array):
        data |= {"re": flat.real.astype(np.float64), "im": flat.imag.astype(np.float64)}
        fields += [T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]
    else:
        kind = T.BooleanType() if flat.dtype == bool else T.LongType() if flat.dtype.kind in "iu" else T.DoubleType()
        data |= {"value": flat.astype({"boolean": bool, "bigint": np.int64, "double": np.float64}[kind.simpleString()])}
        fields.append(T.StructField("value", kind))
    return spark.createDataFrame(pd.DataFrame(data), T.StructType(fields))


def to_array(grid: DataFrame, axes: tuple[str, ...] = ("channel", "baseline"), value: str = "value", shape: tuple[int, ...] | None = None) -> np.ndarray:
    """The grid on the driver, which must hold it; for reports and tests."""
    rows = grid.select(*axes, value).toPandas()
    index = tuple(rows[a].to_numpy() for a in axes)
    shape = shape or tuple(int(i.max()) + 1 for i in index)
    out = np.zeros(shape, rows[value].to_numpy().dtype)
    out[index] = rows[value].to_numpy()
    return out


def generate(spark: SparkSession, times: int, channels: int, baselines: int, seed: int = 1) -> DataFrame:
    """(time, channel, baseline, re, im): independent standard normal parts; made on the executors, reproducible."""
    cells = spark.range(times * channels * baselines)
    i = F.col("id")
    return cells.select(
        F.floor(i / (channels * baselines)).cast("int").alias("time"), (F.floor(i / baselines) % channels).cast("int").alias("channel"), (i % baselines).cast("int").alias("baseline"),
        F.randn(seed).alias("re"), F.randn(seed + 1).alias("im"),
    )


def flag_rate(flags: DataFrame, flag: str = "flag") -> DataFrame:
    """(percent): share of flagged samples."""
    return flags.agg((F.avg(F.col(flag).cast("int")) * 100).alias("percent"))
