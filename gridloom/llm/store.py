"""Tables in and between the stages of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.cluster import cut, free, shared_dir

__all__ = ["cut", "free", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
