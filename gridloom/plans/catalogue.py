"""Registry of the engine's own queries: name -> function of (spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.cluster import scratch
from gridloom.functions import amplitude, fmax, fmin, max_below, median_nonzero, rank_below, zeros
from gridloom.operators import basic, fft, fold, intervals, kernel, reduce, rfi, rolling, select, twod, vectors as blocks
from gridloom.plans import observe, oracles
from gridloom.sources import grids, npy_source, tuning
from gridloom.streaming.assemble import flag_spectra

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The events cube: times, channels.
SHAPE = (grids.DAYS, grids.SLOTS)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits, zero without a sign, so that engines that add in another order agree; the small shift takes exact
    halves off the border."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) + F.lit(0.0) for c in columns})


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.emb2d(spark, sf_dir).select(F.col("baseline").alias("row"), F.col("channel").alias("col"), "value")


def _matrix_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.emb_complex(spark, sf_dir).select(F.col("baseline").alias("row"), F.col("channel").alias("col"), "re", "im")


# Restructuring


@query(oracles.FILL)
def fill(spark, sf_dir):
    return basic.fill(spark, {"row": 75, "col": 63}, 3735928559)


@query(oracles.ZERO)
def zero(spark, sf_dir):
    return basic.zero(_matrix(spark, sf_dir))


@query(oracles.ONES)
def set_ones(spark, sf_dir):
    return basic.fill_like(_matrix(spark, sf_dir), 1)


@query(oracles.SCALE)
def scale(spark, sf_dir):
    return _rounded(basic.scale(_matrix(spark, sf_dir), 3.0), "value")


@query(oracles.TRANSPOSE)
def transpose(spark, sf_dir):
    return _rounded(basic.transpose(_matrix(spark, sf_dir).withColumn("row", F.col("row").cast("int"))), "value")


@query(oracles.REGION_READ)
def region_read(spark, sf_dir):
    return _rounded(basic.region(_matrix(spark, sf_dir), {"row": slice(10, 200, 3), "col": slice(5, 60, 2)}, {"row": 500, "col": 64}), "value")


@query(oracles.REGION_COPY)
def region_copy(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    shape = {"row": 500, "col": 64}
    return _rounded(basic.region_copy(m, basic.scale(m, -1.0), {"row": (0, 50), "col": (0, 40, 2)}, {"row": (100, 150), "col": (8, 28)}, shape, shape), "value")


@query(oracles.REGION_WRITE)
def region_write(spark, sf_dir):
    """A strided rectangle of samples taken from another grid."""
    m = _matrix(spark, sf_dir)
    src = m.filter("row < 30 and col < 10").withColumn("value", (F.col("row") * 1000 + F.col("col")).cast("double"))
    return _rounded(basic.region_write(m, src, {"row": (20, 80, 2), "col": (4, 34, 3)}, {"row": 500, "col": 64}), "value")


@query(oracles.REGION_PROFILE)
def region_profile(spark, sf_dir):
    """One row of the grid as a grid of its own: an integer index drops its axis, and a new axis has one place."""
    return _rounded(basic.region(_matrix(spark, sf_dir), {"row": 7, "col": (2, 60, 5), "pol": None}, {"row": 500, "col": 64}, squeeze=True), "value")


@query(oracles.FLAG_RATE)
def flag_rate(spark, sf_dir):
    return _rounded(grids.flag_rate(grids.ev3d(spark, sf_dir)), "percent")


@query(oracles.FLAG_RATES)
def flag_rates_observed(spark, sf_dir):
    """Rates by baseline, told by the write of the flags."""
    return _rounded(observe.write_flags(grids.ev3d(spark, sf_dir), scratch(spark, "flags")).table(spark), "percent")


@query(oracles.VECTORS)
def vectors(spark, sf_dir):
    v = schema.to_vectors(grids.emb2d(spark, sf_dir))
    back = schema.to_long(v, axis="pos")
    return _rounded(back.groupBy("pos").agg(F.sum("value").alias("total"), F.count("*").alias("n")), "total")


@query(oracles.TRANSPOSE_VECTORS)
def transpose_vectors(spark, sf_dir):
    """Series by channel from series by baseline, by blocks; told by figures that depend on the order."""
    given = grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.col("embedding").alias("values"))
    t = blocks.transpose_vectors(given, channels=16)
    weighted = F.aggregate(F.zip_with("keys", "values", lambda k, v: v * (k % 11)), F.lit(0.0), lambda a, x: a + x)
    out = t.select("channel", F.size("values").alias("n"), F.element_at("keys", -1).alias("last"), F.element_at("values", 1).alias("first_value"), weighted.alias("weighted"))
    return _rounded(out, "first_value", "weighted")


@query(oracles.NPY_SCAN)
def npy_scan(spark, sf_dir):
    """Series written as .npy arrays, an array a task, and read again by byte ranges of some channels."""
    npy_source.register(spark)
    at = scratch(spark, "npy")
    grids.table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>")).write.format("npy").mode("append").save(at)
    rows = npy_source.scan_npy(spark, at, ("row", "channel"), {"channel": (8, 40)}, 1 << 16)
    return _rounded(rows.groupBy("channel").agg(F.count("*").alias("n"), F.sum("re").alias("total"), F.max(F.abs("re")).alias("most")), "total", "most")


@query(oracles.KERNEL)
def kernel_running_sum(spark, sf_dir):
    """A user's kernel: running sums of clipped samples."""
    v = grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.col("embedding").alias("values"))
    made = kernel.kernel(v, lambda x: np.cumsum(np.clip(x, -0.1, 0.1), axis=1))
    return _rounded(made.select("baseline", F.posexplode("values").alias("channel", "value")), "value")


# Reductions


def _hreduce(op):
    def run(spark, sf_dir):
        m = _matrix(spark, sf_dir).withColumn("value", F.round(F.col("value") * 1000).cast("long"))
        return reduce.hreduce(m, op, column_range=(7, 51), size=64)

    return run


for _op in ("sum", "min", "max", "xor"):
    QUERIES[f"hreduce_{_op}"], ORACLES[f"hreduce_{_op}"] = _hreduce(_op), oracles.hreduce(_op)


@query(oracles.HREDUCE_PRODUCT)
def hreduce_product(spark, sf_dir):
    m = _matrix(spark, sf_dir).withColumn("value", 1 + F.col("value") / 10)
    return _rounded(reduce.hreduce(m, "product", column_range=(0, 16), size=64), "value")


@query(oracles.HREDUCE_CUSTOM)
def hreduce_fold(spark, sf_dir):
    """A function of one's own over arrays, combined before the shuffle."""
    m = _matrix(spark, sf_dir).withColumn("value", F.round(F.abs("value") * 1000).cast("long"))
    return fold.fold(m, lambda a, b: (a + b) % 997, 0)


@query(oracles.HREDUCE_CUSTOM)
def hreduce_custom(spark, sf_dir):
    """A fold that is no built-in aggregate: addition modulo 997."""
    m = _matrix(spark, sf_dir).withColumn("value", F.round(F.abs("value") * 1000).cast("long"))
    return reduce.hreduce(m, lambda a, x: (a + x) % 997, 0)


@query(oracles.FILL_REDUCE)
def fill_reduce(spark, sf_dir):
    return reduce.hreduce(basic.fill(spark, {"row": 40, "col": 30}, 7), "sum")


@query(oracles.BLOCK_SUM)
def block_sum(spark, sf_dir):
    series = grids.emb2d(spark, sf_dir).select((F.col("baseline") * 64 + F.col("channel")).alias("i"), "value")
    return _rounded(reduce.block_sum(series, whole=False), "value")


def _mask(spark, sf_dir):
    return grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), ((F.col("vec_id") % 4) / 2).alias("mask"))


@query(oracles.MASKED_SUM)
def masked_sum_complex(spark, sf_dir):
    return _rounded(reduce.masked_sum(_matrix_complex(spark, sf_dir), _mask(spark, sf_dir)), "re", "im")


@query(oracles.MASKED_SUM_AMP)
def masked_sum_amp(spark, sf_dir):
    return _rounded(reduce.masked_sum(_matrix_complex(spark, sf_dir), _mask(spark, sf_dir), amplitudes=True), "value")


@query(oracles.MASKED_MONTHS)
def masked_sum_months(spark, sf_dir):
    m = grids.li2d(spark, sf_dir)
    mask = m.select("row").distinct().withColumn("mask", F.pmod(F.col("row"), F.lit(2)))
    sums = reduce.masked_sum(m, mask, amplitudes=True)
    return sums.withColumn("value", F.round("value", 2))


FIVE = ("min", "max", "q25", "q75", "q50")


@query(oracles.percentile5("abs(value)", "emb2d"))
def percentile5(spark, sf_dir):
    m = _matrix(spark, sf_dir).withColumn("value", F.abs("value"))
    return _rounded(reduce.percentile5(m), *FIVE)


@query(oracles.percentile5("abs(value)", "emb2d", "WHERE channel >= 10 AND channel < 53"))
def percentile5_range(spark, sf_dir):
    m = _matrix(spark, sf_dir).withColumn("value", F.abs("value"))
    return _rounded(reduce.percentile5(m, column_range=(10, 53), size=64, max_columns=64), *FIVE)


@query(oracles.percentile5("sqrt(re * re + im * im)", "embc"))
def percentile5_complex(spark, sf_dir):
    return _rounded(reduce.percentile5(_matrix_complex(spark, sf_dir)), *FIVE)


@query(oracles.ORDER_STATISTIC)
def order_statistic(spark, sf_dir):
    return _rounded(reduce.order_statistic(_matrix(spark, sf_dir), 20, halfway=True), "value")


@query(oracles.percentile5("abs(value)", "emb2d"))
def percentile5_bisect(spark, sf_dir):
    return _rounded(reduce.percentile5(_matrix(spark, sf_dir).withColumn("value", F.abs("value")), method="bisect"), *FIVE)


@query(oracles.ORDER_STATISTIC)
def order_statistic_bisect(spark, sf_dir):
    return _rounded(reduce.order_statistic(_matrix(spark, sf_dir), 20, halfway=True, method="bisect"), "value")


@query(oracles.PRICE_QUANTILES)
def price_quantiles(spark, sf_dir):
    """Order statistics of whole groups; buckets are divided until they hold 200 values."""
    at = {"q25": lambda n: F.floor((n - 1) / 4), "q50": lambda n: F.floor((n - 1) / 2), "q99": lambda n: F.floor(99 * (n - 1) / 100), "most": lambda n: n - 1}
    found = select.select(grids.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", at, 200)
    return found.withColumnRenamed("count", "n")


@query(oracles.PRICE_MEDIANS)
def price_medians(spark, sf_dir):
    """Medians of signed values: keys below and above zero."""
    rows = grids.table(spark, sf_dir, "lineitem").withColumn("signed", F.col("l_extendedprice") * F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1))
    return _rounded(select.medians(rows, ["l_linestatus"], "signed", 1000), "value")


@query(oracles.INTERVALS)
def interval_join(spark, sf_dir):
    """Samples in uneven, overlapping intervals that come as a table."""
    spans = grids.table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0")
    spans = spans.select(F.col("o_orderkey").alias("low"), (F.col("o_orderkey") + 1 + (F.col("o_custkey") * F.col("o_custkey")) % 400).alias("high")).distinct()
    held = intervals.locate(grids.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), spans, "l_orderkey")
    return held.groupBy("low", "high").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query(oracles.RANKS)
def rank_below_points(spark, sf_dir):
    orders = grids.table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("value"))
    points = spark.range(0, 500).select((F.col("id") * 1000.0).alias("point"))
    return reduce.ranks(orders, points)


@query(oracles.RANK_HELPERS)
def rank_helpers(spark, sf_dir):
    v = F.col("value")
    m = _matrix(spark, sf_dir).withColumn("value", F.when(F.col("col") % 7 == 0, 0.0).otherwise(v))
    odd = F.when(F.col("col") % 5 == 0, float("nan")).otherwise(v)
    out = m.groupBy("row").agg(
        rank_below(v, F.lit(0.05)).alias("below"), zeros(v).alias("zeros"), max_below(v, F.lit(0.1)).alias("under"), median_nonzero(v).alias("middle"), fmin(odd).alias("low"), fmax(odd).alias("high")
    )
    return _rounded(out, "under", "middle", "low", "high")


@query(oracles.NEAREST)
def tuning_lookup(spark, sf_dir):
    """Part brands as a parameter store: exact keys fail, so the version, then the platform is given up."""
    part = grids.table(spark, sf_dir, "part")
    store = part.groupBy(F.col("p_brand").alias("device_name"), F.col("p_type").alias("device_platform"), F.col("p_size").cast("string").alias("device_version")).agg(F.count("*").alias("value_n"))
    first = store.agg(F.min("device_name").alias("n")).first()["n"]
    found = tuning.lookup(store, {"device_name": first, "device_platform": "no such", "device_version": "7"})
    return found.select("device_name", "match_level")


@query(oracles.UPSERT)
def tuning_upsert(spark, sf_dir):
    part = grids.table(spark, sf_dir, "part")
    store = part.groupBy(F.col("p_brand").alias("device_name"), F.col("p_size").cast("string").alias("device_version")).agg(F.count("*").alias("value_n"))
    changed = store.filter("device_name < 'Brand#3'").withColumn("value_n", -F.col("value_n"))
    added = store.withColumn("device_name", F.concat("device_name", F.lit("/new")))
    return tuning.upsert(store, changed.unionByName(added), ["device_name", "device_version"])


# One-dimensional flagging


@query(oracles.AMPLITUDE)
def amplitude_complex(spark, sf_dir):
    g = grids.emb_complex(spark, sf_dir)
    return _rounded(g.select("baseline", "channel", amplitude(F.col("re"), F.col("im")).alias("value")), "value")


def _channel_flags(spark):
    return spark.range(0, 64).select(F.col("id").cast("int").alias("channel"), F.when(F.col("id") % 9 == 4, 4).otherwise(0).cast("smallint").alias("flag"))


def _sample_flags(grid):
    return grid.select("baseline", "channel", F.when((F.col("baseline") * 7 + F.col("channel") * 5) % 11 == 0, 2).otherwise(0).cast("smallint").alias("flag"))


@query(oracles.background(13))
def background_median(spark, sf_dir):
    return _rounded(rfi.MedianBackground(13, amplitudes=True)(grids.emb2d(spark, sf_dir)).select("baseline", "channel", "dev"), "dev")


@query(oracles.background(13))
def background_median_ranked(spark, sf_dir):
    return _rounded(rolling.RankedMedianBackground(13, amplitudes=True)(grids.emb2d(spark, sf_dir)).select("baseline", "channel", "dev"), "dev")


@query(oracles.background(101, "((baseline * 7 + channel * 5) % 11 = 0)", "embc", "sqrt(re * re + im * im)"))
def background_median_ranked_wide(spark, sf_dir):
    """A window wider than the series, and flags of samples."""
    g = grids.emb_complex(spark, sf_dir)
    return _rounded(rolling.RankedMedianBackground(101, use_flags=rfi.FULL)(g, _sample_flags(g)).select("baseline", "channel", "dev"), "dev")


@query(oracles.background(6, "(channel % 9 = 4)"))
def background_median_chanflags(spark, sf_dir):
    b = rfi.MedianBackground(6, amplitudes=True, use_flags=rfi.CHANNEL)
    return _rounded(b(grids.emb2d(spark, sf_dir), _channel_flags(spark)).select("baseline", "channel", "dev"), "dev")


@query(oracles.background(5, "((baseline * 7 + channel * 5) % 11 = 0)", "embc", "sqrt(re * re + im * im)"))
def background_median_fullflags(spark, sf_dir):
    g = grids.emb_complex(spark, sf_dir)
    return _rounded(rfi.MedianBackground(5, use_flags=rfi.FULL)(g, _sample_flags(g)).select("baseline", "channel", "dev"), "dev")


@query(oracles.background(13, "(value < 0)"))
def background_median_negative(spark, sf_dir):
    """Negative amplitudes count as flagged."""
    return _rounded(rfi.MedianBackground(13, amplitudes=True, drop_negative=True)(grids.emb2d(spark, sf_dir)).select("baseline", "channel", "dev"), "dev")


@query(oracles.NOISE)
def noise_mad_bounded(spark, sf_dir):
    dev = rfi.MedianBackground(13, amplitudes=True)(grids.emb2d(spark, sf_dir))
    return _rounded(rfi.MadNoise(max_channels=64)(dev).select("baseline", "noise").distinct(), "noise")


@query(oracles.NOISE)
def noise_mad(spark, sf_dir):
    dev = rfi.MedianBackground(13, amplitudes=True)(grids.emb2d(spark, sf_dir))
    return _rounded(rfi.MadNoise().table(dev), "noise")


def _flagged(threshold, mode=rfi.NONE, every=False):
    def run(spark, sf_dir):
        g = grids.emb2d(spark, sf_dir)
        flags = {rfi.NONE: None, rfi.CHANNEL: _channel_flags(spark), rfi.FULL: _sample_flags(g)}[mode]
        out = rfi.Flagger(rfi.MedianBackground(13, amplitudes=True, use_flags=mode), rfi.MadNoise(), threshold)(g, flags)
        out = out.select("baseline", "channel", F.col("flag").cast("int").alias("flag"))
        return out if every else out.filter("flag <> 0")

    return run


SIMPLE, SUMS = rfi.SimpleThreshold(2.0), rfi.SumThreshold(1.5, flag_value=3)
QUERIES["rfi_flag_simple"], ORACLES["rfi_flag_simple"] = _flagged(SIMPLE), oracles.flag_simple(2.0)
QUERIES["threshold_simple"], ORACLES["threshold_simple"] = _flagged(SIMPLE, every=True), oracles.flag_simple(2.0, every=True)
QUERIES["threshold_sum"], ORACLES["threshold_sum"] = _flagged(SUMS, every=True), oracles.flag_sum(1.5, 4, 3)
QUERIES["flagger_sum_chanflags"], ORACLES["flagger_sum_chanflags"] = _flagged(SUMS, rfi.CHANNEL, True), oracles.flag_sum(1.5, 4, 3, "(channel % 9 = 4)")
QUERIES["flagger_sum_fullflags"], ORACLES["flagger_sum_fullflags"] = _flagged(SUMS, rfi.FULL, True), oracles.flag_sum(1.5, 4, 3, "((baseline * 7 + channel * 5) % 11 = 0)")



@query(oracles.flag_simple(2.0))
def rfi_flag_stream(spark, sf_dir):
    """The flags of ``rfi_flag_simple`` from a stream that splits every series between three micro-batches."""
    at = scratch(spark, "stream")
    samples = grids.emb2d(spark, sf_dir).withColumns({"time": F.lit(0), "ts": F.timestamp_seconds(F.lit(grids.FIRST_DAY))})
    # A third of the channels after the other, each by all tasks that read the table: all thirds have as many files, and a micro-batch takes the files of one.
    for third in range(3):
        samples.filter(F.col("channel") % 3 == third).write.parquet(f"{at}/in/{third}")
    files = max(1, len(spark.read.schema(samples.schema).parquet(f"{at}/in/0").inputFiles()))
    stream = spark.readStream.schema(samples.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{at}/in")
    flagger = rfi.Flagger(rfi.MedianBackground(13, amplitudes=True), rfi.MadNoise(), SIMPLE)
    sink = lambda df, n: df.filter("flag <> 0").select("baseline", "channel", "flag").write.mode("overwrite").parquet(f"{at}/out/{n}")
    flag_spectra(stream, flagger, 64, sink, f"{at}/state").awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema("baseline long, channel int, flag smallint").parquet(f"{at}/out")


PADDED = rfi.SumThreshold(1.5, flag_value=3, padded=True)
QUERIES["threshold_sum_padded"], ORACLES["threshold_sum_padded"] = _flagged(PADDED, every=True), oracles.flag_sum(1.5, 4, 3, padded=64)


# Two-dimensional flagging


@query(oracles.average_freq(5))
def average_freq(spark, sf_dir):
    return _rounded(twod.average_freq(grids.ev3d(spark, sf_dir), 5), "value")


@query(oracles.average_freq(5))
def average_freq_int_flags(spark, sf_dir):
    """Flags as small integers."""
    g = grids.ev3d(spark, sf_dir)
    return _rounded(twod.average_freq(g.withColumn("flag", F.col("flag").cast("smallint")), 5), "value")


@query(oracles.average_freq(4, "(channel * 7 + time * 3) % 11 < 4"))
def average_freq_nan(spark, sf_dir):
    """NaN samples are left out of the means; a bin without any other is flagged."""
    lost = (F.col("channel") * 7 + F.col("time") * 3) % 11 < 4
    g = grids.ev3d(spark, sf_dir).withColumn("value", F.when(lost, float("nan")).otherwise(F.col("value")))
    return _rounded(twod.average_freq(g, 4), "value")


@query(oracles.TIME_MEDIAN)
def time_median(spark, sf_dir):
    return _rounded(twod.time_median(grids.ev3d(spark, sf_dir)), "value")


@query(oracles.median_abs(["baseline"]))
def median_abs(spark, sf_dir):
    return _rounded(twod.median_abs(grids.ev3d(spark, sf_dir)), "value")


@query(oracles.median_abs(["baseline", "channel"]))
def median_abs_axis0(spark, sf_dir):
    return _rounded(twod.median_abs(grids.ev3d(spark, sf_dir), ("baseline", "channel")), "value")


@query(oracles.INTERPOLATE)
def interpolate_gaps(spark, sf_dir):
    g = grids.ev3d(spark, sf_dir).withColumn("value", F.when(~F.col("flag"), F.col("value")))
    return _rounded(twod.interpolate_gaps(g).select("baseline", "time", "channel", "value"), "value")


@query(oracles.BOX)
def box_filter(spark, sf_dir):
    return _rounded(twod.box_filter(grids.ev3d(spark, sf_dir), ("baseline", "time"), "channel", 2, SHAPE[1], 4).select("baseline", "time", "channel", "value"), "value")


@query(oracles.masked_gaussian(3.0, 2.3))
def masked_gaussian(spark, sf_dir):
    return _rounded(twod.masked_gaussian(grids.ev3d(spark, sf_dir), (3.0, 2.3), SHAPE).select("baseline", "time", "channel", "background"), "background")


ENDS = twod.chunk_ends(SHAPE[1], 4)


@query(oracles.background2d(3.0, 2.3, ENDS, 2, 2.0))
def background2d(spark, sf_dir):
    return _rounded(twod.background2d(grids.ev3d(spark, sf_dir), SHAPE, (3.0, 2.3), ENDS, 2, 2.0).select("baseline", "time", "channel", "background"), "background")


def _centred(spark, sf_dir):
    g = grids.ev3d(spark, sf_dir)
    return g.withColumn("value", F.when(F.col("flag"), 0.0).otherwise(F.col("value") - 50))


@query(oracles.sum_threshold("channel", 1.2, ENDS))
def sum_threshold_freq(spark, sf_dir):
    return twod.sum_threshold(_centred(spark, sf_dir), "channel", [1, 2, 4, 8], 1.2, 1.3, ENDS).select("baseline", "time", "channel", "found")


@query(oracles.sum_threshold("time", 1.2, None))
def sum_threshold_time(spark, sf_dir):
    return twod.sum_threshold(_centred(spark, sf_dir), "time", [1, 2, 4, 8], 1.2, 1.3).select("baseline", "time", "channel", "found")


@query(oracles.COMBINE)
def combine_flags(spark, sf_dir):
    g = grids.ev3d(spark, sf_dir).withColumns({"a": F.col("value") > 97, "b": (F.col("channel") * 31 + F.col("time") * 17) % 53 == 0})
    return twod.combine_flags(g, ("a", "b"), 4).select("baseline", "time", "channel", "flag")


@query(oracles.UNAVERAGE)
def unaverage_freq(spark, sf_dir):
    g = grids.ev3d(spark, sf_dir).withColumn("flag", (F.col("value") > 90) | (F.col("time") % 13 == 3) & (F.col("channel") < 9))
    return twod.unaverage_freq(g, 3 * SHAPE[1] - 2, SHAPE[0], 3, 4, 0.3, 0.5)


SMALL = twod.SumThresholdFlagger(outlier_nsigma=1.6, background_reject=1.5, spike_width_time=3.0, spike_width_freq=2.5, freq_chunks=4)
AVERAGED = twod.SumThresholdFlagger(outlier_nsigma=1.3, windows_freq=(1, 2, 4), background_iterations=2, spike_width_time=2.0, spike_width_freq=6.0, time_extend=2, freq_extend=1, freq_chunks=3, average_freq=5, flag_all_time_frac=0.4, flag_all_freq_frac=0.5)


def _twod(flagger):
    return lambda spark, sf_dir: flagger.get_flags(grids.ev3d(spark, sf_dir), SHAPE)


for _name, _flagger in (("twod_flagger", SMALL), ("twod_flagger_averaged", AVERAGED), ("twod_flagger_defaults", twod.SumThresholdFlagger())):
    QUERIES[_name], ORACLES[_name] = _twod(_flagger), oracles.twod_flagger(_flagger, *SHAPE)
LOST = "(channel * 7 + time * 3) % 11 = 4"


@query(oracles.twod_flagger(SMALL, *SHAPE, LOST))
def twod_flagger_nan(spark, sf_dir):
    """NaN samples take no part in any figure and are flagged in the output."""
    g = grids.ev3d(spark, sf_dir).withColumn("value", F.when(F.expr(LOST), float("nan")).otherwise(F.col("value")))
    return SMALL.get_flags(g, SHAPE)


#: The same flags by tiles of 8 times and about 12 channels, with halos.
QUERIES["twod_flagger_tiled"], ORACLES["twod_flagger_tiled"] = _twod(replace(SMALL, tile=(8, 12))), ORACLES["twod_flagger"]
QUERIES["twod_flagger_averaged_tiled"], ORACLES["twod_flagger_averaged_tiled"] = _twod(replace(AVERAGED, tile=(11, 4))), ORACLES["twod_flagger_averaged"]


# Fourier transforms


@query(oracles.DFT)
def dft_power(spark, sf_dir):
    return _rounded(fft.dft_power(grids.emb2d(spark, sf_dir), 64), "power")


@query(oracles.FFT)
def fft_udf(spark, sf_dir):
    v = grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.col("embedding").cast("array<double>").alias("re"))
    z = fft.fft(v, (64,), fft.R2C)
    out = z.select("baseline", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("baseline", "k", "z.re", "z.im")
    return _rounded(out, "re", "im")


@query(oracles.FFT_ROUND)
def fft_round_trip(spark, sf_dir):
    v = grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), F.col("embedding").cast("array<double>").alias("re"))
    z = fft.fft(fft.fft(v, (8, 8), fft.R2C), (8, 8), fft.C2R, fft.INVERSE)
    return _rounded(z.select("baseline", F.posexplode("re").alias("k", "value")), "value")


def _complex_vectors(spark, sf_dir):
    e, half = F.col("embedding").cast("array<double>"), F.sequence(F.lit(0), F.lit(31))
    part = lambda k: F.transform(half, lambda i: F.get(e, i * 2 + k))
    return grids.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("baseline"), part(0).alias("re"), part(1).alias("im"))


def _spectrum(z):
    return z.select("baseline", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z")).select("baseline", "k", "z.re", "z.im")


@query(oracles.FFT_C2C)
def fft_c2c(spark, sf_dir):
    return _rounded(_spectrum(fft.fft(_complex_vectors(spark, sf_dir), (32,))), "re", "im")


@query(oracles.FFT_C2C_INVERSE)
def fft_c2c_inverse(spark, sf_dir):
    return _rounded(_spectrum(fft.fft(_complex_vectors(spark, sf_dir), (32,), fft.C2C, fft.INVERSE)), "re", "im")


@query(oracles.FFT_SINGLE)
def fft_single(spark, sf_dir):
    """Single precision is near double precision, whatever the rounding."""
    v = _complex_vectors(spark, sf_dir)
    a, b = _spectrum(fft.fft(v, (32,), single=True)), _spectrum(fft.fft(v, (32,)))
    both = a.join(b.withColumnsRenamed({"re": "re2", "im": "im2"}), ["baseline", "k"])
    return both.select("baseline", "k", (F.hypot(F.col("re") - F.col("re2"), F.col("im") - F.col("im2")) < 1e-4).alias("near"), (F.col("re") == F.col("re").cast("float").cast("double")).alias("single"))
