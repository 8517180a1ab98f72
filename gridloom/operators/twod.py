"""Two-dimensional flagging of (baseline, time, channel) cubes.

Cubes are dense: every (time, channel) of a baseline has a row, as frames count rows. Every stage keeps to one baseline, so a
grid that is partitioned by baseline is not shuffled again; no key of a window is wider than that. Helper columns begin
with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import ceil, log2, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cluster import cut
from gridloom.functions import MAD_NORMAL, median
from gridloom.schema import GRID3, with_boolean

#: This and the defaults of SumThresholdFlagger.
PASSES = 4
#: A baseline of up to so many cells is one task's work, and one exchange by baseline then serves all windows of a stage. Larger ones are
#: cut into tiles of about so many times and channels, with halos.
CELLS_A_TASK, TILE = 4_000_000, (512, 1024)


def require_dense(grid: DataFrame, axes: dict[str, int], keys: Sequence[str] = ("baseline",)) -> DataFrame:
    """``grid``; a ValueError unless each group of ``keys`` has every cell of ``axes`` (name -> size) once. One aggregation, combined
    before its shuffle, runs at once."""
    total, inside = 1, F.lit(True)
    for name, size in axes.items():
        total *= size
        inside = inside & F.coalesce((F.col(name) >= 0) & (F.col(name) < size), F.lit(False))
    cells = grid.groupBy(*keys, *axes).agg(F.count("*").alias("_k"), F.bool_and(inside).alias("_in"))
    bad = cells.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_k").alias("_most"), F.bool_and("_in").alias("_all"))
    if first := bad.filter((F.col("_n") != total) | (F.col("_most") > 1) | ~F.col("_all")).first():
        raise ValueError(f"the grid of {[first[k] for k in keys]} is not dense: {first['_n']} of {total} cells")
    return grid


def average_freq(cube: DataFrame, factor: int) -> DataFrame:
    """Mean magnitude of ``factor`` channels at a time, over unflagged samples that are not NaN; without any 0 and flagged. The
    last bin may be ragged. The input has ``value``, or ``re`` and ``im``."""
    if factor < 1:
        raise ValueError("the factor is positive")
    cube = with_boolean(cube)
    size = F.hypot("re", "im") if "re" in cube.columns else F.abs(F.col("value").cast("double"))
    good = F.when(~F.col("flag") & ~F.isnan(size), size)
    binned = cube.groupBy("baseline", "time", F.floor(F.col("channel") / factor).cast("int").alias("channel")).agg(F.avg(good).alias("_mean"))
    return binned.select("baseline", "time", "channel", F.coalesce("_mean", F.lit(0.0)).alias("value"), F.col("_mean").isNull().alias("flag"))


def time_median(cube: DataFrame) -> DataFrame:
    """(baseline, channel, value, flag): median over time of unflagged samples; without any 0 and flagged."""
    medians = with_boolean(cube).groupBy("baseline", "channel").agg(median(F.when(~F.col("flag"), F.col("value"))).alias("_m"))
    return medians.select("baseline", "channel", F.coalesce("_m", F.lit(0.0)).alias("value"), F.col("_m").isNull().alias("flag"))


def median_abs(cube: DataFrame, keys: Sequence[str] = ("baseline",)) -> DataFrame:
    """(keys, value): median absolute value of unflagged samples, NULL without any; keys beyond the baseline give it along an axis."""
    return with_boolean(cube).groupBy(*keys).agg(median(F.when(~F.col("flag"), F.abs("value"))).alias("value"))


def nearest_known(rows: DataFrame, keys: Sequence[str], axis: str, value: str) -> DataFrame:
    """Adds _l and _r: (x, y) of the nearest sample with a value at or before and at or after each along ``axis``, NULL where there is none."""
    order = W.partitionBy(*keys).orderBy(axis)
    rows = rows.withColumn("_k", F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(axis).alias("x"), F.col(value).alias("y"))))
    return rows.withColumns({
        "_l": F.last("_k", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)),
        "_r": F.first("_k", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)),
    }).drop("_k")


def between(left: Column, right: Column, axis: str) -> Column:
    """On the straight line between two known samples; the nearest where one is missing, 0 where both are. A known sample is its own neighbour."""
    line = left["y"] + (right["y"] - left["y"]) * (F.col(axis) - left["x"]) / (right["x"] - left["x"])
    return (
        F.when(left.isNull() & right.isNull(), 0.0).when(left.isNull(), right["y"]).when(right.isNull(), left["y"])
        .when(left["x"] == right["x"], left["y"]).otherwise(line)
    )


def interpolate_gaps(series: DataFrame, keys: Sequence[str] = ("baseline", "time"), axis: str = "channel", value: str = "value") -> DataFrame:
    """Missing values on a straight line between their neighbours along ``axis``, the nearest beyond the ends, 0 where all is missing."""
    rows = nearest_known(series, keys, axis, value)
    return rows.withColumn(value, between(F.col("_l"), F.col("_r"), axis)).drop("_l", "_r")


def radius(sigma: float, passes: int = PASSES) -> int:
    """Of the box whose ``passes``-fold convolution has about the width of a Gaussian of ``sigma``."""
    return int(0.5 * sqrt(12 * sigma * sigma / passes + 1))


def box_sums(grid: DataFrame, keys: Sequence[str], axis: str, r: int, size: int, columns: Sequence[str], passes: int = PASSES) -> DataFrame:
    """``columns`` convolved ``passes`` times along ``axis`` by a box of 2r + 1 ones, as if zeros surrounded the axis, whose indices are
    0 to size - 1. Tails outside are kept between passes: edge rows bring their own padding, without a join."""
    if r == 0:
        return grid
    pad = r * passes
    at, first, last = F.col(axis), F.col(axis) == 0, F.col(axis) == size - 1
    places = F.when(first & last, F.sequence(at - pad, at + pad)).when(first, F.sequence(at - pad, at)).when(last, F.sequence(at, at + pad)).otherwise(F.array(at))
    rows = grid.withColumn("_p", F.explode(places))
    inside = F.col("_p") == F.col(axis)
    rows = rows.withColumns({c: F.when(inside, F.col(c).cast("double")).otherwise(0.0) for c in columns}).withColumn("_in", inside)
    frame = W.partitionBy(*keys).orderBy("_p").rowsBetween(-r, r)
    for _ in range(passes):
        rows = rows.withColumns({c: F.sum(c).over(frame) for c in columns})
    return rows.filter("_in").drop("_p", "_in")


def box_filter(grid: DataFrame, keys: Sequence[str], axis: str, r: int, size: int, passes: int = 1, value: str = "value") -> DataFrame:
    """Mean over a moving box of 2r + 1 samples, ``passes`` times."""
    return box_sums(grid, keys, axis, r, size, [value], passes).withColumn(value, F.col(value) / float((2 * r + 1) ** passes))


def gaussian(grid: DataFrame, sigma: tuple[float, float], shape: tuple[int, int], columns: Sequence[str] = ("value",), passes: int = PASSES, keys: Sequence[str] = ("baseline",)) -> DataFrame:
    """Approximate Gaussian along time and channel; an axis whose radius is 0 is left alone. Sums, not means."""
    if len(sigma) != 2:
        raise ValueError("sigma has one entry for time and one for channel")
    out = box_sums(grid, [*keys, "channel"], "time", radius(sigma[0], passes), shape[0], columns, passes)
    return box_sums(out, [*keys, "time"], "channel", radius(sigma[1], passes), shape[1], columns, passes)


def masked_gaussian(cube: DataFrame, sigma: tuple[float, float], shape: tuple[int, int], passes: int = PASSES, out: str = "background") -> DataFrame:
    """Adds ``out``: the Gaussian mean of unflagged samples, NULL where none has weight. Weights are whole numbers, so that zero is exact."""
    rows = with_boolean(cube).withColumns({"_num": F.when(~F.col("flag"), F.col("value").cast("double")).otherwise(0.0), "_den": F.when(~F.col("flag"), 1.0).otherwise(0.0)})
    rows = gaussian(rows, sigma, shape, ["_num", "_den"], passes)
    return rows.withColumn(out, F.when(F.col("_den") != 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")


def chunk_ends(size: int, chunks: int) -> list[int]:
    """Ends of ``chunks`` even intervals of [0, size), rounded down; 0 comes first, empty ones are dropped."""
    return sorted({int(x) for x in np.linspace(0, size, chunks + 1)})


def _chunk(axis: str, ends: Sequence[int]) -> Column:
    at = F.lit(0)
    for end in ends[1:-1]:
        at = at + F.when(F.col(axis) >= end, 1).otherwise(0)
    return at


def background2d(cube: DataFrame, shape: tuple[int, int], sigma: tuple[float, float], ends: Sequence[int], iterations: int = 1, reject: float = 2.0) -> DataFrame:
    """Adds ``background``: a masked Gaussian, before which outliers are masked ``iterations`` times, each with a narrower Gaussian; its gaps are interpolated along channel.

    Outliers differ from the background by more than ``reject`` deviations of their frequency chunk.
    """
    rows = with_boolean(cube).withColumn("_given", F.col("flag")).withColumn("_c", _chunk("channel", ends))
    for e in range(iterations, 0, -1):
        rows = masked_gaussian(rows, (e * sigma[0], e * sigma[1]), shape)
        rows = rows.withColumn("_res", F.abs(F.col("value") - F.col("background")))
        limit = median(F.when(~F.col("flag"), F.col("_res"))).over(W.partitionBy("baseline", "_c")) * (MAD_NORMAL * reject)
        rows = rows.withColumn("_lim", limit).withColumn("flag", F.col("flag") | F.coalesce(F.col("_res") > F.col("_lim"), F.lit(False))).drop("background", "_res", "_lim")
        if e > 1:
            rows = cut(rows, "background")
    rows = masked_gaussian(rows, sigma, shape)
    rows = interpolate_gaps(rows, ("baseline", "time"), "channel", "background")
    return rows.withColumn("flag", F.col("_given")).drop("_given", "_c")


def threshold_passes(rows: DataFrame, keys: Sequence[str], axis: str, windows: Sequence[int], rho: float, out: str) -> DataFrame:
    """Adds ``out``: the two-sided passes of ``sum_threshold`` over series of ``keys`` along ``axis``, whose limit for single samples is ``_t``."""
    order = W.partitionBy(*keys).orderBy(axis)
    rows = rows.withColumns({"_pos": F.lit(False), "_neg": F.lit(False)})
    for w in windows:
        limit = F.col("_t") / float(rho ** log2(w))
        held = F.when(F.col("_pos") & (F.col("value") > limit), limit).when(F.col("_neg") & (F.col("value") < -limit), -limit).otherwise(F.col("value"))
        back = order.rowsBetween(-(w - 1), 0)
        rows = rows.withColumn("_d", held)
        rows = rows.withColumns({"_s": F.sum("_d").over(back) / float(w), "_n": F.count(F.lit(1)).over(back)})
        whole, ahead = F.col("_n") == w, order.rowsBetween(0, w - 1)
        rows = rows.withColumns({"_hp": whole & (F.col("_s") > limit), "_hn": whole & (-F.col("_s") > limit)})
        rows = rows.withColumns({"_pos": F.col("_pos") | F.max("_hp").over(ahead), "_neg": F.col("_neg") | F.max("_hn").over(ahead)})
    return rows.withColumn(out, F.col("_pos") | F.col("_neg")).drop("_pos", "_neg", "_d", "_s", "_n", "_hp", "_hn")


def sum_threshold(cube: DataFrame, axis: str, windows: Sequence[int], n_sigma: float = 4.5, rho: float = 1.3, ends: Sequence[int] | None = None, out: str = "found") -> DataFrame:
    """Adds ``out``: two-sided sum-threshold flags along ``axis``.

    Each chunk of the axis has its own noise, from its unflagged samples, and sees its neighbours up to the longest
    window. For a window of w the limit is T / rho ** log2(w); samples already found and beyond it count as it; the mean of a
    complete window beyond the limit flags all its samples. Positive and negative excursions are kept apart.
    """
    if axis not in ("time", "channel"):
        raise ValueError(f"no axis {axis!r}")
    other = "channel" if axis == "time" else "time"
    windows = list(windows)
    pad = max(windows) - 1 if windows else 0
    rows = with_boolean(cube)
    if ends is None or len(ends) <= 2:
        rows = rows.withColumns({"_c": F.lit(0), "_own": F.lit(True)})
    else:
        near = F.array_compact(F.array(*[F.when((F.col(axis) >= a - pad) & (F.col(axis) < b + pad), F.lit(k)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]))
        rows = rows.withColumn("_home", _chunk(axis, ends)).withColumn("_c", F.explode(near)).withColumn("_own", F.col("_home") == F.col("_c")).drop("_home")
    column = W.partitionBy("baseline", other, "_c")
    spread = median(F.when(F.col("_own") & ~F.col("flag"), F.abs("value"))).over(column) * (n_sigma * MAD_NORMAL)
    rows = rows.withColumn("_t", F.coalesce(spread, F.lit(float("inf"))))
    rows = threshold_passes(rows, ("baseline", other, "_c"), axis, windows, rho, out)
    return rows.filter("_own").drop("_c", "_own", "_t")


def smeared(flag: Column, keys: Sequence[str], axis: str, width: int) -> Column:
    """Flags widened by ``width`` samples along ``axis``, clipped at its ends."""
    return F.max(flag).over(W.partitionBy(*keys).orderBy(axis).rowsBetween(-(width // 2), width - 1 - width // 2))


def combine_flags(cube: DataFrame, sources: Sequence[str], extend: int = 3, out: str = "flag") -> DataFrame:
    """Sets ``out``: any of ``sources``, widened in time."""
    either = F.lit(False)
    for c in sources:
        either = either | F.col(c)
    rows = cube.withColumn("_any", either)
    return rows.withColumn(out, smeared(F.col("_any"), ("baseline", "channel"), "time", extend)).drop("_any")


def unaverage_freq(cube: DataFrame, channels: int, times: int, factor: int = 1, extend: int = 3, time_frac: float = 0.6, freq_frac: float = 0.8) -> DataFrame:
    """(baseline, time, channel, flag) of ``channels`` channels: each flag on all it was averaged from, widened in frequency; a time with more than
    ``freq_frac`` of its channels flagged is flagged whole, and so is a channel with more than ``time_frac`` of its times, both
    counted before either is done."""
    low = F.col("channel") * factor
    rows = with_boolean(cube).select("baseline", "time", "flag", F.explode(F.sequence(low, F.least(low + factor - 1, F.lit(channels - 1)))).alias("channel"))
    rows = rows.withColumn("_f", smeared(F.col("flag"), ("baseline", "time"), "channel", extend))
    rows = rows.withColumn("_t", F.sum(F.col("_f").cast("int")).over(W.partitionBy("baseline", "time")))
    rows = rows.withColumn("_k", F.sum(F.col("_f").cast("int")).over(W.partitionBy("baseline", "channel")))
    whole = F.col("_f") | (F.col("_t") > freq_frac * channels) | (F.col("_k") > time_frac * times)
    return rows.select("baseline", "time", "channel", whole.alias("flag"))


@dataclass(frozen=True)
class SumThresholdFlagger:
    """The two-dimensional flagger: spectrum, time and frequency passes over background-subtracted magnitudes."""

    outlier_nsigma: float = 4.5
    windows_time: Sequence[int] = field(default=(1, 2, 4, 8))
    windows_freq: Sequence[int] = field(default=(1, 2, 4, 8))
    background_reject: float = 2.0
    background_iterations: int = 1
    spike_width_time: float = 12.5
    spike_width_freq: float = 10.0
    time_extend: int = 3
    freq_extend: int = 3
    freq_chunks: int = 10
    average_freq: int = 1
    flag_all_time_frac: float = 0.6
    flag_all_freq_frac: float = 0.8
    rho: float = 1.3
    #: Looks for missing and repeated cells first; frames count rows, so such a cube would get wrong flags.
    check_dense: bool = False
    #: (times, channels) of a tile; None: whole baselines up to CELLS_A_TASK cells, and tiles of TILE beyond.
    tile: tuple[int, int] | None = None

    def get_flags(self, cube: DataFrame, shape: tuple[int, int]) -> DataFrame:
        """(baseline, time, channel, flag) for a dense cube (baseline, time, channel, value or re and im, flag) of ``shape`` (times, channels).

        Input flags steer the estimates and are not copied to the output; a NaN input is flagged. Baselines are
        independent: the grid is partitioned by them, larger ones by tiles with halos, and results between stages go to the shared folder.
        """
        if "re" not in cube.columns:
            GRID3.validate(cube, "cube")
        cube = with_boolean(cube)
        times, channels = shape
        if self.check_dense:
            require_dense(cube, {"time": times, "channel": channels})
        windows_time, windows_freq, ends, spike_freq = self.derived(channels)
        averaged = ends[-1]
        if self.tile is not None or times * averaged > CELLS_A_TASK:
            from gridloom.operators import tiles  # it is built from what stands above

            return self._with_lost(tiles.get_flags(self, cube, shape, self.tile or TILE), cube)

        def whole(df: DataFrame, name: str) -> DataFrame:
            return cut(df, name).repartition("baseline")

        grid = whole(average_freq(cube, self.average_freq), "averaged")
        grid = grid.join(self.spectrum_flags(grid, channels), ["baseline", "channel"]).withColumn("flag", F.col("flag") | F.col("spec"))
        grid = background2d(grid, (times, averaged), (self.spike_width_time, spike_freq), ends, self.background_iterations, self.background_reject)
        grid = whole(grid.withColumn("value", F.col("value") - F.col("background")).drop("background"), "residual")
        grid = sum_threshold(grid, "time", windows_time, self.outlier_nsigma, self.rho, None, "in_time")
        grid = grid.withColumn("flag", F.col("flag") | F.col("in_time"))
        grid = whole(sum_threshold(grid, "channel", windows_freq, self.outlier_nsigma, self.rho, ends, "in_freq"), "found")
        grid = combine_flags(grid, ("spec", "in_time", "in_freq"), self.time_extend)
        flags = unaverage_freq(grid, channels, times, self.average_freq, self.freq_extend, self.flag_all_time_frac, self.flag_all_freq_frac)
        return self._with_lost(flags, cube)

    def derived(self, channels: int) -> tuple[list[int], list[int], list[int], float]:
        """Windows along time and along averaged channels, ends of the averaged channels' chunks, and the spike width in averaged channels."""
        averaged = -(-channels // self.average_freq)
        windows_freq = sorted({w for w in (ceil(w / self.average_freq) for w in self.windows_freq) if w <= averaged})
        # Fixed rule: time windows are held against the number of channels; one longer than the times is never complete.
        return [w for w in self.windows_time if w <= channels], windows_freq, chunk_ends(averaged, self.freq_chunks), self.spike_width_freq / self.average_freq

    def spectrum_flags(self, grid: DataFrame, channels: int) -> DataFrame:
        """(baseline, channel, spec): flags of the averaged ``grid``'s median spectra, in a table of its own."""
        _, windows_freq, ends, spike_freq = self.derived(channels)
        spectrum = time_median(grid).withColumn("time", F.lit(0))
        spectrum = background2d(spectrum, (1, ends[-1]), (0.0, spike_freq), ends, self.background_iterations, self.background_reject)
        spectrum = spectrum.withColumn("value", F.col("value") - F.col("background")).drop("background")
        return cut(sum_threshold(spectrum, "channel", windows_freq, self.outlier_nsigma, self.rho, ends, "spec").select("baseline", "channel", "spec"), "spectrum")

    def _with_lost(self, flags: DataFrame, cube: DataFrame) -> DataFrame:
        value = F.col("re") + F.col("im") if "re" in cube.columns else F.col("value")
        lost = cube.filter(F.isnan(value.cast("double")) | value.isNull()).select("baseline", "time", "channel", F.lit(True).alias("_lost"))
        return flags.join(lost, ["baseline", "time", "channel"], "left").select("baseline", "time", "channel", (F.col("flag") | F.coalesce("_lost", F.lit(False))).alias("flag"))
