"""Streams that split spectra: the flags are those of the table, and state goes away."""

import glob
import math
import os
import random
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.operators import rfi
from gridloom.plans import catalogue
from gridloom.streaming.assemble import Assembler, _packing, assemble, flag_spectra

CHANNELS = 30
SCHEMA = "baseline int, time int, channel int, value double, ts timestamp"
FLAGGER = rfi.Flagger(rfi.MedianBackground(7, amplitudes=True), rfi.MadNoise(), rfi.SumThreshold(8.0))


def spectra(spark):
    r = np.random.default_rng(4)
    value = np.abs(r.normal(0, 1, (3, 4, CHANNELS)))
    value[r.random(value.shape) < 0.03] += 50
    rows = [(b, t, c, float(value[b, t, c]), t) for b in range(3) for t in range(4) for c in range(CHANNELS)]
    return rows, spark.createDataFrame([x[:4] for x in rows], "baseline int, time int, channel int, value double")


def written(spark, parts, at):
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "baseline int, time int, channel int, value double, s int")
        df.select("baseline", "time", "channel", "value", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s") * 60).alias("ts")).coalesce(1).write.parquet(f"{at}/in/{k:02d}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def test_any_split_gives_the_flags_of_the_table(spark, tmp_path):
    rows, table = spectra(spark)
    whole = FLAGGER(table.withColumn("baseline", F.struct("baseline", "time")).drop("time"))
    want = sorted((x["baseline"]["baseline"], x["baseline"]["time"], x["channel"], x["flag"]) for x in whole.collect())
    assert any(x[3] for x in want)
    mixed = rows + rows[:40]  # some samples come twice
    random.Random(1).shuffle(mixed)
    stream = written(spark, [mixed[k::4] for k in range(4)], tmp_path)
    got = []
    flag_spectra(stream, FLAGGER, CHANNELS, lambda df, n: got.extend((x["baseline"], x["time"], x["channel"], x["flag"]) for x in df.collect()), f"{tmp_path}/state").awaitTermination()
    assert sorted(set(got)) == want
    assert len(got) == len(want)


def test_what_is_never_whole_is_handed_on_and_forgotten(spark, tmp_path):
    rows, _ = spectra(spark)
    first = [x for x in rows if x[1] == 0 and not (x[0] == 1 and x[2] > 20)]  # baseline 1 lacks channels
    later = [(9, 9, c, 1.0, 120 * k) for k in (1, 2) for c in range(CHANNELS)]
    stream = written(spark, [first, later[:CHANNELS], later[CHANNELS:], [(8, 8, 0, 1.0, 500)]], tmp_path)
    query = assemble(stream, CHANNELS, wait="5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(x["baseline"], x["time"], x["whole"]): x["n"] for x in spark.read.parquet(f"{tmp_path}/out").groupBy("baseline", "time", "whole").agg(F.count("*").alias("n")).collect()}
    assert got.pop((1, 0, False)) == 21
    assert got == {(0, 0, True): CHANNELS, (2, 0, True): CHANNELS, (9, 9, True): 2 * CHANNELS}
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert state <= 4  # the last spectrum's sample, its count and its timer
    assert glob.glob(f"{tmp_path}/state/state/*")


def test_the_query_reads_each_third_from_many_files(spark, tmp_path, monkeypatch):
    """Its input was written by one task, so one file fed each micro-batch."""
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    def spied(stream, flagger, channels, sink, checkpoint):
        seen.extend(len(glob.glob(f"{os.path.dirname(checkpoint)}/in/{k}/*.parquet")) for k in range(3))
        query = flag_spectra(stream, flagger, channels, sink, checkpoint)
        query.awaitTermination()
        seen.append(query.lastProgress["batchId"])
        return query

    monkeypatch.setattr(catalogue, "flag_spectra", spied)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = sorted(map(tuple, catalogue.rfi_flag_stream(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] >= 3 and seen[:3] == [seen[0]] * 3 and seen[3] >= 2
    assert got == sorted(map(tuple, catalogue.QUERIES["rfi_flag_simple"](spark, str(tmp_path)).collect())) != []


def test_a_batch_makes_few_calls_for_a_spectrum():
    """As many for 20 samples as for one: each call is a round trip."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def get(self):
            calls.append(f"{self.name}.get")
            return iter(self.held) if self.name == "samples" else (self.held or [None])[0]

        def appendValue(self, value):  # noqa: N802
            calls.append(f"{self.name}.append")
            self.held.append(value)

        def update(self, value):
            calls.append(f"{self.name}.update")
            self.held = [value]

        def clear(self):
            calls.append(f"{self.name}.clear")
            self.held = []

    class Handle:
        getListState = getValueState = lambda self, name, schema: State(name)  # noqa: N815
        registerTimer = deleteTimer = lambda self, at: calls.append("timer")  # noqa: N815

    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    schema = pa.schema([("channel", pa.int32()), ("value", pa.float64()), ("ts", pa.timestamp("us", tz="UTC"))])
    a = Assembler(["baseline"], schema, 60, 1000, "ts")
    a.init(Handle())

    def batch(k):
        rows = pa.RecordBatch.from_pylist([{"baseline": 7, "channel": c, "value": math.nan if c == 3 else 1.0 * c, "ts": at} for c in range(k, 60, 3)], pa.schema([("baseline", pa.int64()), *schema]))
        (pack,) = _packing(["baseline"], schema.names, "ts")(iter([rows]))
        return iter([Row(**x) for x in pack.to_pylist()])

    assert list(a.handleInputRows((7,), batch(2), None)) == [] and len(calls) == 4
    assert list(a.handleInputRows((7,), batch(0), None)) == [] and len(calls) == 7  # the timer stands
    (out,) = a.handleInputRows((7,), batch(1), None)
    assert len(calls) == 12
    rows = pa.ipc.read_record_batch(pa.py_buffer(out.told), schema).to_pylist()
    assert [r["channel"] for r in rows] == list(range(60)) and out.whole and math.isnan(rows[3]["value"])
