"""Spectra put together from a stream that splits them: samples wait in keyed state until their spectrum is whole, or until time runs out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridloom.cluster import ship
from gridloom.operators.rfi import Flagger
from gridloom.streaming import flag_stream

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packing(keys: Sequence[str], columns: Sequence[str], when: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Samples of a spectrum that stand in one Arrow batch and have one time become a row: keys, time, how many, and the samples as an Arrow message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            names = [*keys, when]
            found = t.select(names).append_column("_at", pa.array(np.arange(t.num_rows))).group_by(names, use_threads=False).aggregate([("_at", "list")])
            at = found["_at_list"].combine_chunks()
            rows = t.select(list(columns)).take(at.flatten()).combine_chunks().to_batches()[0]
            n = at.value_lengths().to_numpy()
            ends = np.cumsum(n)
            told = [rows.slice(high - k, k).serialize().to_pybytes() for high, k in zip(ends.tolist(), n.tolist(), strict=True)]
            out = found.select(names).append_column("n", pa.array(n, pa.int64())).append_column("told", pa.array(told, pa.binary()))
            yield from out.combine_chunks().to_batches()

    return run


def _unpacking(keys: Sequence[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in batch.column("told").to_pylist()]
            of = pa.array(np.repeat(np.arange(len(parts)), [p.num_rows for p in parts]))
            own = pa.Table.from_batches([batch]).select([*keys, "whole"]).take(of)
            rows = pa.Table.from_batches(parts, schema)
            out = pa.table([*(own[k] for k in keys), *rows.columns, own["whole"]], names=[*keys, *schema.names, "whole"])
            yield from out.combine_chunks().to_batches()

    return run


class Assembler(StatefulProcessor):
    """State of one spectrum: its samples so far in packs, how many there are, and, by a timer, when to give up.

    What a spectrum costs is rows that Python reads one by one and calls to the state store, so samples come packed, and a batch makes few calls for a spectrum, whatever its number of samples."""

    def __init__(self, keys: Sequence[str], schema: pa.Schema, channels: int, wait_ms: int, when: str):
        self.keys, self.schema, self.channels, self.wait_ms, self.when = list(keys), schema, channels, wait_ms, when

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "told binary")
        self.count = handle.getValueState("count", "n long, until long")
        self.made = Row(*self.keys, "told", "whole")

    def _once(self, packs: Sequence[bytes]) -> pa.RecordBatch:
        """The last sample of each channel, in order of channels."""
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(p)), self.schema) for p in packs], self.schema)
        _, back = np.unique(rows["channel"].to_numpy()[::-1], return_index=True)
        return rows.take(pa.array(rows.num_rows - 1 - back)).combine_chunks().to_batches()[0]

    def _told(self) -> list[bytes]:
        return [told[0] for told in list(self.samples.get())]

    def _forget(self, until: int | None) -> None:
        self.samples.clear()
        self.count.clear()
        if until is not None:
            self.handle.deleteTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        given = [(r[self.when], r["n"], bytes(r["told"])) for r in rows]
        count, packs = sum(g[1] for g in given), [g[2] for g in given]
        until = max((int(g[0].timestamp() * 1000) + self.wait_ms for g in given if g[0] is not None), default=self.wait_ms)
        held, before = self.count.get() or (0, None)
        if held + count < self.channels:
            self._keep(packs, held + count, until, before)
            return
        every = self._once([*self._told(), *packs] if held else packs)
        if held:
            self._forget(before)
        if every.num_rows < self.channels:
            # Samples that came twice: what is known stays, once.
            self._keep([every.serialize().to_pybytes()], every.num_rows, max(until, before or until), None)
            return
        yield self.made(*key, every.serialize().to_pybytes(), True)

    def _keep(self, packs: list[bytes], held: int, until: int, before: int | None) -> None:
        if len(packs) == 1:
            self.samples.appendValue((packs[0],))
        else:
            self.samples.appendList([(p,) for p in packs])
        until = max(until, before or until)
        self.count.update((held, until))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        packs = self._told()
        self._forget(None)
        if packs:
            yield self.made(*key, self._once(packs).serialize().to_pybytes(), False)

    def close(self) -> None:
        pass


def assemble(samples: DataFrame, channels: int, keys: Sequence[str] = ("baseline", "time"), when: str = "ts", wait: str = "10 minutes") -> DataFrame:
    """The samples of whole spectra (``keys``), a spectrum in one micro-batch, with ``whole``; however the stream splits and orders them.

    ``samples`` is a stream of LONG rows with a timestamp ``when``. A spectrum is whole when ``channels`` different channels have come; a sample that comes again replaces the earlier one.
    Spectra that lack samples when the watermark is ``wait`` behind their last one are handed on as they are, ``whole`` false. Either way their state is removed;
    samples later than the watermark are dropped by the engine.
    """
    spark = samples.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    fields = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    columns = [c for c in fields if c not in keys]
    told = lambda names: ", ".join(f"{c} {fields[c]}" for c in names)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    kinds = spark.createDataFrame([], samples.select(*columns).schema).toArrow().schema
    packs = samples.mapInArrow(_packing(keys, columns, when), f"{told([*keys, when])}, n long, told binary").withWatermark(when, wait)
    made = packs.groupBy(*keys).transformWithState(Assembler(keys, kinds, channels, wait_ms, when), f"{told(keys)}, told binary, whole boolean", "Append", "eventTime")
    return made.mapInArrow(_unpacking(keys, kinds), f"{told(keys)}, {told(columns)}, whole boolean")


def flag_spectra(
    samples: DataFrame, flagger: Flagger, channels: int, sink: Callable[[DataFrame, int], None], checkpoint: str, keys: Sequence[str] = ("baseline", "time"), when: str = "ts", wait: str = "10 minutes", once: bool = True,
) -> StreamingQuery:
    """Flags spectra that a stream may split between micro-batches: assembled first, then flagged like a table of spectra; ``sink`` gets the keys' own columns back."""

    def each(df: DataFrame, n: int) -> None:
        sink(df.withColumns({k: F.col(f"baseline.{k}") for k in [*(k for k in keys if k != "baseline"), *(["baseline"] if "baseline" in keys else [])]}), n)

    spectra = assemble(samples, channels, keys, when, wait).withColumn("baseline", F.struct(*keys))
    return flag_stream(spectra.drop(*[k for k in keys if k != "baseline"]), flagger, each, checkpoint, once)
