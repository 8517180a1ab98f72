"""The two-dimensional flagger over tiles with halos, for baselines of any size.

A tile is a stretch of times and a run of whole frequency chunks. Before a stage every sample is sent to its own tile and to those that have it
in their halo, as wide as the stage looks; the stage's windows, along either axis, then all lie within a tile, so a stage has one exchange, and what it finds
for a tile's own samples is what the undivided baseline gives. Figures of whole columns or chunks (medians, counts) are aggregated from the tables between the stages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.cluster import cut, free
from gridloom.functions import MAD_NORMAL, median
from gridloom.operators import select, twod

KEYS = ("baseline", "_bt", "_bc")


def _array(xs: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(x)) for x in xs])


@dataclass(frozen=True)
class Tiles:
    """Tiles of ``times`` times and of runs of whole ``chunks`` of about ``channels`` channels, one chunk at least; ``chunks`` are ends, 0 first."""

    shape: tuple[int, int]
    times: int
    channels: int
    chunks: Sequence[int]

    def channel_ends(self) -> list[int]:
        ends = [0]
        for low, end in zip(self.chunks[:-1], self.chunks[1:], strict=True):
            if ends[-1] != low and end - ends[-1] > self.channels:
                ends.append(low)
        return [*ends, self.chunks[-1]] if self.chunks[-1] > ends[-1] else ends

    def own(self) -> tuple[Column, Column]:
        """Numbers of a sample's own tile along both axes."""
        inner = self.channel_ends()[1:-1]
        at = F.lit(0) if not inner else F.size(F.filter(_array(inner), lambda e: e <= F.col("channel")))
        return F.floor(F.col("time") / self.times).cast("int"), at.cast("int")

    def dealt(self, grid: DataFrame, halo: tuple[int, int], columns: DataFrame | None = None, named: Sequence[str] = ()) -> DataFrame:
        """``grid`` with _bt, _bc (tile) and _own, each sample in every tile whose halo it is in, after one exchange by baseline and tile.

        ``columns`` (baseline, channel, and ``named``, of types that have an order) are figures of whole columns: they travel in the same exchange, as rows of
        their own, and are spread over the column within the tile; there is no join.
        """
        last = max(0, -(-self.shape[0] // self.times) - 1)
        ends = self.channel_ends()
        own_t, own_c = self.own()
        first = lambda at: F.greatest(F.floor((F.col("time") - at) / self.times), F.lit(0)).cast("int")
        near_t = F.sequence(first(halo[0]), F.least(F.floor((F.col("time") + halo[0]) / self.times), F.lit(last)).cast("int"))
        bounds = list(zip(ends[:-1], ends[1:], strict=True))
        near_c = F.array_compact(F.array(*[F.when((F.col("channel") >= a - halo[1]) & (F.col("channel") < b + halo[1]), F.lit(k)) for k, (a, b) in enumerate(bounds)]))
        rows = grid.withColumns({"_ot": own_t, "_oc": own_c}).withColumn("_bt", F.explode(near_t)).withColumn("_bc", F.explode(near_c))
        rows = rows.withColumn("_own", (F.col("_bt") == F.col("_ot")) & (F.col("_bc") == F.col("_oc"))).drop("_ot", "_oc")
        if columns is None:
            return rows.repartition(*KEYS)
        extra = columns.select("baseline", "channel", *named).withColumn("_bt", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("_bc", F.explode(near_c))
        rows = rows.unionByName(extra, allowMissingColumns=True).repartition(*KEYS)
        return rows.withColumns({c: F.max(c).over(W.partitionBy(*KEYS, "channel")) for c in named}).filter("time is not null")


def _backgrounds(rows: DataFrame, tiles: Tiles, sigma: tuple[float, float]) -> DataFrame:
    """Adds ``background``, correct for a tile's own samples if the halo is ``_reach(sigma)``."""
    rows = rows.withColumns({"_num": F.when(~F.col("flag"), F.col("value").cast("double")).otherwise(0.0), "_den": F.when(~F.col("flag"), 1.0).otherwise(0.0)})
    rows = twod.gaussian(rows, sigma, tiles.shape, ["_num", "_den"], keys=KEYS)
    return rows.withColumn("background", F.when(F.col("_den") != 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")


def _reach(sigma: tuple[float, float]) -> tuple[int, int]:
    return tuple(twod.radius(s) * twod.PASSES for s in sigma)


def _filled(rows: DataFrame) -> DataFrame:
    """``rows`` (own samples, with _bc, background, _l, _r) with ``value`` less the background; gaps that reach beyond their tile get the
    nearest known samples of the tiles beside, and only these samples are joined."""
    less = lambda left, right: F.col("value") - twod.between(left, right, "channel")
    closed = rows.filter("_l is not null and _r is not null")
    closed = closed.withColumn("value", F.col("value") - F.coalesce("background", twod.between(F.col("_l"), F.col("_r"), "channel")))
    gaps = rows.filter("_l is null or _r is null")
    if gaps.isEmpty():
        return closed.drop("background", "_l", "_r")
    known = F.when(F.col("background").isNotNull(), F.struct(F.col("channel").alias("x"), F.col("background").alias("y")))
    ends = rows.groupBy("baseline", "time", "_bc").agg(F.min(known).alias("_first"), F.max(known).alias("_last"))
    order = W.partitionBy("baseline", "time").orderBy("_bc")
    beside = ends.select(
        "baseline", "time", "_bc",
        F.last("_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    gaps = gaps.join(beside, ["baseline", "time", "_bc"])
    gaps = gaps.withColumn("value", less(F.coalesce("_l", "_before"), F.coalesce("_r", "_after"))).select(*closed.columns)
    return closed.unionByName(gaps).drop("background", "_l", "_r")


def _chunk_noise(rows: DataFrame, value: Column, cells: int) -> DataFrame:
    """(baseline, _c, _m): medians of whole chunks, by selection where a chunk may hold more than a task should."""
    given = rows.withColumn("_v", value)
    if cells > select.LIMIT:
        return select.medians(given, ("baseline", "_c"), "_v", out="_m")
    return given.groupBy("baseline", "_c").agg(median(F.col("_v")).alias("_m"))


def residuals(cube: DataFrame, tiles: Tiles, sigma: tuple[float, float], iterations: int, reject: float, spectrum: DataFrame) -> DataFrame:
    """``cube`` (baseline, time, channel, value, flag) less its background, with _bc, ``spec`` and, in ``flag``, the flags of ``spectrum`` (baseline, channel, spec) too.

    As ``twod.background2d``: ``iterations`` stages mask outliers, one more smooths; each has one exchange, and its table replaces the one before.
    """
    cells = tiles.shape[0] * max(b - a for a, b in zip(tiles.chunks[:-1], tiles.chunks[1:], strict=True))
    chunk = F.size(F.filter(_array(tiles.chunks[1:-1]), lambda e: e <= F.col("channel"))) if len(tiles.chunks) > 2 else F.lit(0)
    given, columns, named, held = cube, spectrum, ("spec",), None
    for e in range(iterations, -1, -1):
        width = tuple(max(e, 1) * s for s in sigma)
        rows = tiles.dealt(given, _reach(width), columns, named)
        if columns is not None:
            rows = rows.withColumn("_given", F.col("flag") | F.col("spec")).withColumn("flag", F.col("_given"))
        rows = _backgrounds(rows, tiles, width)
        # Backgrounds of the halo are not whole, so gaps see a tile's own samples only.
        rows = rows.filter("_own").drop("_own")
        rows = rows.drop("_bc") if e else twod.nearest_known(rows, (*KEYS, "time"), "channel", "background")
        kept = cut(rows.drop("_bt").withColumn("_c", chunk), "background")
        if held is not None:
            free(held)
        held = kept
        if e:
            apart = F.abs(F.col("value") - F.col("background"))
            noise = _chunk_noise(kept.filter(~F.col("flag")), apart, cells)
            over = F.coalesce(apart > F.col("_m") * (MAD_NORMAL * reject), F.lit(False))
            given = kept.join(F.broadcast(noise), ["baseline", "_c"], "left").withColumn("flag", F.col("flag") | over).drop("background", "_m", "_c")
            columns, named = None, ()
    out = cut(_filled(kept.withColumn("flag", F.col("_given")).drop("_given", "_c")), "residual")
    free(kept)
    return out


def get_flags(flagger: twod.SumThresholdFlagger, cube: DataFrame, shape: tuple[int, int], tile: tuple[int, int]) -> DataFrame:
    """``flagger.get_flags`` by tiles of ``tile`` (times, channels)."""
    times, channels = shape
    windows_time, windows_freq, ends, spike_freq = flagger.derived(channels)
    averaged = ends[-1]
    tiles = Tiles((times, averaged), tile[0], tile[1], ends)
    grid = cut(twod.average_freq(cube, flagger.average_freq), "averaged")
    spectrum = flagger.spectrum_flags(grid, channels)
    residual = residuals(grid, tiles, (flagger.spike_width_time, spike_freq), flagger.background_iterations, flagger.background_reject, spectrum)
    free(grid, spectrum)

    # Limits along time are figures of whole columns; those along frequency lie within a tile.
    unflagged = residual.filter(~F.col("flag")).withColumn("_v", F.abs("value"))
    column = ("baseline", "channel")
    spread = select.medians(unflagged, column, "_v", out="_t") if times > select.LIMIT else unflagged.groupBy(*column).agg(median(F.col("_v")).alias("_t"))
    limits = spread.withColumn("_t", F.col("_t") * (flagger.outlier_nsigma * MAD_NORMAL))
    # A sample's flag depends on at most so many samples to each side: every window in turn adds its length.
    reach, pad = sum(w - 1 for w in windows_time), max(windows_freq, default=1) - 1
    rows = tiles.dealt(residual.drop("_bc"), (reach, pad), limits, ("_t",)).withColumn("_t", F.coalesce("_t", F.lit(float("inf"))))
    rows = twod.threshold_passes(rows, (*KEYS, "channel"), "time", windows_time, flagger.rho, "in_time").drop("_t")
    rows = rows.withColumn("flag", F.col("flag") | F.col("in_time")).filter(F.col("_bt") == F.floor(F.col("time") / tiles.times))
    inner = tiles.channel_ends()
    mine = [next(k for k, (a, b) in enumerate(zip(inner[:-1], inner[1:], strict=True)) if a <= low < b) for low in ends[:-1]]
    near = [F.when((F.col("_bc") == mine[k]) & (F.col("channel") >= a - pad) & (F.col("channel") < b + pad), F.struct(F.lit(k).alias("c"), ((F.col("channel") >= a) & (F.col("channel") < b)).alias("home"))) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    rows = rows.drop("_own").withColumn("_w", F.explode(F.array_compact(F.array(*near)))).withColumns({"_c": F.col("_w.c"), "_own": F.col("_w.home")}).drop("_w")
    noise = median(F.when(F.col("_own") & ~F.col("flag"), F.abs("value"))).over(W.partitionBy(*KEYS, "time", "_c")) * (flagger.outlier_nsigma * MAD_NORMAL)
    rows = rows.withColumn("_t", F.coalesce(noise, F.lit(float("inf"))))
    rows = twod.threshold_passes(rows, (*KEYS, "time", "_c"), "channel", windows_freq, flagger.rho, "in_freq")
    found = cut(rows.filter("_own").select("baseline", "time", "channel", (F.col("spec") | F.col("in_time") | F.col("in_freq")).alias("flag")), "found")
    free(residual)

    # Widening in time and, after the channels are those of the input again, in frequency.
    wide, factor = flagger.freq_extend, flagger.average_freq
    rows = tiles.dealt(found, (flagger.time_extend, -(-wide // factor) + 1))
    rows = rows.withColumn("flag", twod.smeared(F.col("flag"), (*KEYS, "channel"), "time", flagger.time_extend)).filter(F.col("_bt") == F.floor(F.col("time") / tiles.times))
    low = F.col("channel") * factor
    rows = rows.withColumn("channel", F.explode(F.sequence(low, F.least(low + factor - 1, F.lit(channels - 1)))))
    rows = rows.withColumn("flag", twod.smeared(F.col("flag"), (*KEYS, "time"), "channel", wide))
    flags = cut(rows.filter("_own").select("baseline", "time", "channel", "flag"), "widened")
    free(found)
    total = lambda by, most: flags.groupBy("baseline", by).agg(F.sum(F.col("flag").cast("int")).alias("_n")).filter(F.col("_n") > most).select("baseline", by, F.lit(True).alias(f"_all_{by}"))
    rows = flags.join(total("time", flagger.flag_all_freq_frac * channels), ["baseline", "time"], "left").join(total("channel", flagger.flag_all_time_frac * times), ["baseline", "channel"], "left")
    whole = F.col("flag") | F.coalesce("_all_time", F.lit(False)) | F.coalesce("_all_channel", F.lit(False))
    return rows.select("baseline", "time", "channel", whole.alias("flag"))
