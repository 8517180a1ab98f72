"""A table of tuned parameters: exact and nearest lookup, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.sources.store_writer import latest, read_version, write_version

DEVICE = ("device_name", "device_platform", "device_version")


def lookup(store: DataFrame, keys: dict, nearest: bool = True) -> DataFrame:
    """The row, if any, that agrees with all ``keys``; else, if ``nearest``, with all but the device's version, then without
    its platform too, then without its name too. The column ``match_level`` says how many were given up."""
    unknown = set(keys) - set(store.columns)
    if unknown:
        raise ValueError(f"no columns {sorted(unknown)}")
    fixed = F.lit(True)
    for k, v in keys.items():
        if k not in DEVICE:
            fixed = fixed & F.col(k).eqNullSafe(F.lit(v))
    same = {k: F.col(k).eqNullSafe(F.lit(keys[k])) if k in keys else F.lit(True) for k in DEVICE}
    name, platform, version = (same[k] for k in DEVICE)
    level = F.when(name & platform & version, 0)
    if nearest:
        level = level.when(name & platform, 1).when(name, 2).otherwise(3)
    found = store.filter(fixed).withColumn("match_level", level).filter("match_level is not null")
    return found.orderBy("match_level", *sorted(store.columns)).limit(1)


def upsert(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with ``rows`` in place of what has the same keys; of rows with the same keys the last by value stays."""
    order = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in rows.columns if c not in keys] or [F.lit(0)])
    rows = rows.select(store.columns).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    on = F.lit(True)
    for k in keys:
        on = on & store[k].eqNullSafe(rows[k])
    return store.join(rows, on, "left_anti").unionByName(rows)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The store at ``path`` as it was last saved, or as of ``version``."""
    return read_version(spark, path, version)


def save(path: str, rows: DataFrame, keys: list[str], on: int | None = None) -> DataFrame:
    """Creates the store at ``path`` with ``rows``, or upserts them into it; the store as read back.

    Each save is a new version beside the old ones, made from the last one, or from ``on`` if given. Of saves that run at the same time, or if ``on`` is no longer the last, one wins
    and the others raise ``Conflict``, so that no update is lost; a save that fails leaves no rows. No rows are no save.
    """
    spark = rows.sparkSession
    on = latest(path) if on is None else on
    merged = upsert(rows.limit(0) if on < 0 else read_version(spark, path, on).select(rows.columns), rows, keys)
    if not rows.isEmpty():
        write_version(merged, path, on)
    return load(spark, path)
