"""Flags a .npy file or generated data and prints the flag rate and the seconds: ``python -m gridloom --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import rfi, twod
from gridloom.plans.jobs import elapsed
from gridloom.sources import grids, npy

#: Fixed values, as are the defaults of the arguments: workload sizes (channels, antennas); an antenna count of n gives 2 n (n + 1) baselines.
PRESETS = {"small": (26, 2), "medium": (128, 15), "kat7": (8192, 7), "big": (10240, 64)}


def baselines(antennas: int) -> int:
    return antennas * (antennas + 1) * 2


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    p.add_argument("file", nargs="?", help="a complex .npy array (channel, baseline), or (time, channel, baseline) with --times")
    p.add_argument("--preset", choices=PRESETS)
    p.add_argument("--channels", type=int, default=1024)
    p.add_argument("--antennas", type=int, default=7)
    p.add_argument("--times", type=int, default=0, help="flag a cube of so many times in two dimensions")
    p.add_argument("--width", type=int, default=13)
    p.add_argument("--sigmas", type=float, default=11.0)
    p.add_argument("--windows", type=int, default=4, help="0: single samples only")
    p.add_argument("--flags", help="write the flags as Parquet")
    p.add_argument("--master")
    return p.parse_args(given)


def flags_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    channels, antennas = PRESETS[a.preset] if a.preset else (a.channels, a.antennas)
    axes = ("time", "channel", "baseline") if a.times else ("channel", "baseline")
    vis = npy.read_npy(spark, a.file, axes) if a.file else grids.generate(spark, a.times or 1, channels, baselines(antennas))
    if not a.times:
        threshold = rfi.SumThreshold(a.sigmas, a.windows) if a.windows else rfi.SimpleThreshold(a.sigmas)
        return rfi.Flagger(rfi.MedianBackground(a.width), rfi.MadNoise(), threshold)(vis).select("channel", "baseline", (F.col("flag") != 0).alias("flag"))
    size = vis.agg((F.max("time") + 1).alias("t"), (F.max("channel") + 1).alias("c")).first()
    return twod.SumThresholdFlagger().get_flags(vis.withColumn("flag", F.lit(False)), (size["t"], size["c"]))


def main(given: list[str] | None = None) -> float:
    a = arguments(given)
    builder = SparkSession.builder.appName("gridloom").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()

    def action() -> float:
        flags = flags_of(spark, a)
        if a.flags:
            flags.write.mode("overwrite").parquet(a.flags)
            flags = spark.read.parquet(a.flags)
        return grids.flag_rate(flags).first()["percent"]

    percent, seconds = elapsed(action)
    print(f"{percent:.3f} % flagged in {seconds:.2f} s")
    return percent


if __name__ == "__main__":
    main()
