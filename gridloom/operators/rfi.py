"""One-dimensional flagging: background, noise, threshold, and their composition.

All stages are windows over (baseline, channel); with the grid partitioned by baseline they share one exchange and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import amplitude, mad_noise, median

#: How input flags reach the background: not at all, a flag a channel, a flag a sample.
NONE, CHANNEL, FULL = "none", "channel", "full"


class Background(Protocol):
    def __call__(self, vis: DataFrame, flags: DataFrame | None = None) -> DataFrame: ...


class Noise(Protocol):
    def __call__(self, deviations: DataFrame) -> DataFrame: ...


class Threshold(Protocol):
    def __call__(self, deviations: DataFrame) -> DataFrame: ...


def flag_mode(mode: str | bool) -> str:
    mode = {True: CHANNEL, False: NONE}.get(mode, mode)
    if mode not in (NONE, CHANNEL, FULL):
        raise ValueError(f"no flag mode {mode!r}")
    return mode


@dataclass(frozen=True)
class MedianBackground:
    """Adds ``dev``: amplitude less the median of the ``width`` samples around it, which shrink at the band's edges.

    Flagged and missing samples are no part of a median and have deviation 0. ``amplitudes``: the input has ``value``
    instead of ``re`` and ``im``. ``drop_negative``: a negative amplitude counts as flagged. Flags are a table (channel, flag) or (baseline,
    channel, flag), any non-zero value flags; the small one is broadcast by the planner.
    """

    width: int
    amplitudes: bool = False
    use_flags: str | bool = NONE
    drop_negative: bool = False

    def __call__(self, vis: DataFrame, flags: DataFrame | None = None) -> DataFrame:
        mode = flag_mode(self.use_flags)
        if self.width < 1:
            raise ValueError("the width is positive")
        if (flags is None) != (mode == NONE):
            raise TypeError("flags are needed" if flags is None else "this background takes no flags")
        size = F.col("value").cast("double") if self.amplitudes else amplitude(F.col("re"), F.col("im"))
        rows = vis.withColumn("_amp", size)
        valid = F.col("_amp").isNotNull() & ~F.isnan("_amp")
        if self.drop_negative:
            valid = valid & (F.col("_amp") >= 0)
        if mode != NONE:
            keys = ["channel"] if mode == CHANNEL else ["baseline", "channel"]
            rows = rows.join(flags.select(*keys, F.col("flag").cast("int").alias("_in")), keys, "left")
            valid = valid & (F.coalesce("_in", F.lit(0)) == 0)
        return self._deviations(rows.withColumn("_ok", F.when(valid, F.col("_amp"))))

    def _deviations(self, rows: DataFrame) -> DataFrame:
        """Adds ``dev`` to rows with _ok, the amplitude where it is valid."""
        frame = W.partitionBy("baseline").orderBy("channel").rowsBetween(-(self.width // 2), (self.width - 1) // 2)
        rows = rows.withColumn("dev", F.coalesce(F.col("_ok") - median(F.col("_ok")).over(frame), F.lit(0.0)))
        return rows.drop("_amp", "_ok", "_in")


@dataclass(frozen=True)
class MadNoise:
    """Adds ``noise``: 1.4826 times the median of the baseline's non-zero absolute deviations, NULL without any. A
    baseline of more than ``max_channels`` samples fails the job."""

    max_channels: int | None = None

    def _bounded(self, noise: Column, samples: Column) -> Column:
        if self.max_channels is None:
            return noise
        return F.when(samples > self.max_channels, F.raise_error(F.lit(f"a baseline has more than {self.max_channels} channels"))).otherwise(noise)

    def __call__(self, deviations: DataFrame) -> DataFrame:
        every = W.partitionBy("baseline")
        return deviations.withColumn("noise", self._bounded(mad_noise(F.col("dev"), every), F.count(F.lit(1)).over(every)))

    def table(self, deviations: DataFrame) -> DataFrame:
        """(baseline, noise)"""
        return deviations.groupBy("baseline").agg(self._bounded(mad_noise(F.col("dev")), F.count(F.lit(1))).alias("noise"))


@dataclass(frozen=True)
class SimpleThreshold:
    """Adds ``flag``: ``flag_value`` where dev > n_sigma * noise, else 0; no noise, no flag."""

    n_sigma: float
    flag_value: int = 1

    def __call__(self, deviations: DataFrame) -> DataFrame:
        hit = F.coalesce(F.col("dev") > F.lit(float(self.n_sigma)) * F.col("noise"), F.lit(False))
        return deviations.withColumn("flag", F.when(hit, self.flag_value).otherwise(0).cast("smallint"))


def _held(flag: Column, value: Column, otherwise: Column) -> Column:
    return F.when(flag, value).otherwise(otherwise)


@dataclass(frozen=True)
class SumThreshold:
    """Adds ``flag`` by sums over windows of 1, 2, 4, ... samples, each against its own, falling threshold.

    Samples flagged so far count as the threshold itself; only complete windows count; the sum must be greater; each sample of
    such a window is flagged. Thresholds are single precision, as the sums' comparands have always been. ``padded``: zeros
    surround the band, so windows that reach beyond its ends count too; channels are then dense from 0.
    """

    n_sigma: float
    n_windows: int = 4
    falloff: float = 1.2
    flag_value: int = 1
    padded: bool = False

    def __call__(self, deviations: DataFrame) -> DataFrame:
        series = W.partitionBy("baseline").orderBy("channel")
        rows = deviations
        if self.padded:
            # As many zeros as the windows together can reach; the first and the last row bring them.
            reach, at = 2**self.n_windows, F.col("channel")
            rows = rows.withColumn("_end", F.max("channel").over(W.partitionBy("baseline")))
            below, above = F.when(at == 0, at - reach).otherwise(at), F.when(at == F.col("_end"), at + reach).otherwise(at)
            rows = rows.withColumn("_p", F.explode(F.sequence(below, above))).withColumn("_in", F.col("_p") == at)
            rows = rows.withColumn("_kept", F.col("dev")).withColumn("dev", F.when(F.col("_in"), F.col("dev")).otherwise(0.0)).drop("_end")
            series = W.partitionBy("baseline").orderBy("_p")
        rows = rows.withColumn("_f", F.lit(False))
        for i in range(self.n_windows):
            w = 2**i
            threshold = (F.lit(float(self.n_sigma)) * F.col("noise") * F.lit(self.falloff**-i)).cast("float").cast("double")
            rows = rows.withColumn("_t", threshold)
            rows = rows.withColumn("_d", _held(F.col("_f"), F.col("_t"), F.col("dev")))
            back = series.rowsBetween(-(w - 1), 0)
            rows = rows.withColumns({"_s": F.sum("_d").over(back), "_n": F.count(F.lit(1)).over(back)})
            rows = rows.withColumn("_hit", F.coalesce((F.col("_n") == w) & (F.col("_s") > F.col("_t") * w), F.lit(False)))
            rows = rows.withColumn("_f", F.col("_f") | F.max("_hit").over(series.rowsBetween(0, w - 1)))
        if self.padded:
            rows = rows.filter("_in").withColumn("dev", F.col("_kept")).drop("_p", "_in", "_kept")
        out = rows.withColumn("flag", F.when(F.col("_f"), self.flag_value).otherwise(0).cast("smallint"))
        return out.drop("_f", "_t", "_d", "_s", "_n", "_hit")


@dataclass(frozen=True)
class Flagger:
    """background -> noise -> threshold. Input flags steer the background only; they are not copied to the output."""

    background: Background
    noise: Noise
    threshold: Threshold

    def __call__(self, vis: DataFrame, flags: DataFrame | None = None) -> DataFrame:
        return self.threshold(self.noise(self.background(vis, flags)))
