"""Rolling medians by rank updates: a sorted window with insertion and removal, over many stretches of samples at a time.

Samples are cut into stretches of ``width`` outputs with their halo, 2 * width - 1 samples. Within a stretch each sample has a rank; the window is a tree of counts over
ranks, in which adding a sample, taking one out and finding the k-th each take one step a level, of which there are about log2(2 * width). All stretches of a batch
take the same step together, in NumPy, so a sample costs as many array operations as the tree has levels, whatever the width.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.operators.rfi import MedianBackground

#: Samples that are gathered before they are worked on; counts that the trees of one lot of stretches hold.
STEP, COUNTS = 1 << 20, 1 << 23


def rolling_medians(values: np.ndarray, width: int) -> np.ndarray:
    """For each sample the interpolating median of the samples from width // 2 before it to (width - 1) // 2 behind it; NaN samples are not in
    the window, nor is what lies beyond the ends, and a window without any sample gives NaN."""
    n, before, behind = len(values), width // 2, (width - 1) // 2
    if not n:
        return np.zeros(0)
    stretches = -(-n // width)
    padded = np.full(before + stretches * width + behind, np.nan)
    padded[before : before + n] = values
    every = np.lib.stride_tricks.sliding_window_view(padded, 2 * width - 1)[::width]
    levels = max(1, int(2 * width - 2).bit_length())
    lot = max(1, COUNTS >> (levels + 1))
    out = [_stretches(every[low : low + lot], width, levels) for low in range(0, stretches, lot)]
    return np.concatenate(out).ravel()[:n]


def _stretches(samples: np.ndarray, width: int, levels: int) -> np.ndarray:
    count, leaves = len(samples), 1 << levels
    order = np.argsort(samples, axis=1, kind="stable")
    ranks = np.empty(order.shape, np.int64)
    np.put_along_axis(ranks, order, np.arange(samples.shape[1])[None, :], 1)
    ranked = np.take_along_axis(samples, order, 1)
    real = ~np.isnan(samples)
    # A tree a row: node 1 is the root, node k has children 2k and 2k + 1, the leaves stand in order of rank.
    tree = np.zeros(count * 2 * leaves, np.int32)
    root = np.arange(count) * 2 * leaves
    held = np.zeros(count, np.int64)

    def put(column: int, by: int) -> None:
        rows = np.flatnonzero(real[:, column])
        node, base = ranks[rows, column] + leaves, root[rows]
        held[rows] += by
        for _ in range(levels + 1):
            tree[base + node] += by
            node >>= 1

    def find(k: np.ndarray) -> np.ndarray:
        node = np.ones(count, np.int64)
        for _ in range(levels):
            node *= 2
            left = tree[root + node]
            right = k >= left
            k = k - np.where(right, left, 0)
            node += right
        return ranked[np.arange(count), np.minimum(node - leaves, ranked.shape[1] - 1)]

    out = np.empty((count, width))
    for column in range(samples.shape[1]):
        put(column, 1)
        if column >= width:
            put(column - width, -1)
        if column >= width - 1:
            low, high = find(np.maximum(held - 1, 0) // 2), find(held // 2)
            middle = np.where(held % 2 == 1, low, low * 0.5 + high * 0.5)
            out[:, column - width + 1] = np.where(held > 0, middle, np.nan)
    return out


@dataclass(frozen=True)
class RankedMedianBackground(MedianBackground):
    """``MedianBackground`` by rank updates: the same deviations, at a cost that grows as the logarithm of the width.

    Rows are dealt by baseline and sorted by channel, then pass through Arrow in runs of STEP samples; a baseline's last samples wait for the ones behind them, so a
    task holds a run and a window, however long a baseline is.
    """

    def _deviations(self, rows: DataFrame) -> DataFrame:
        ship(rows.sparkSession)
        width, before, behind = self.width, self.width // 2, (self.width - 1) // 2

        def medians(table: pa.Table) -> tuple[np.ndarray, int]:
            """(medians as far as the samples known here go, where the last series begins)"""
            keys = table["_series"].combine_chunks()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:].to_numpy() != keys[:-1].to_numpy()) + 1])
            # Between two series lies as much emptiness as a window reaches.
            place = np.arange(len(keys)) + before * (np.searchsorted(starts, np.arange(len(keys)), "right") - 1)
            line = np.full(int(place[-1]) + 1, np.nan)
            line[place] = table["_ok"].fill_null(np.nan).to_numpy()
            return rolling_medians(line, width)[place], int(starts[-1])

        def done(table: pa.Table, middle: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
            part = table.slice(low, high - low)
            dev = part["_ok"].fill_null(np.nan).to_numpy() - middle[low:high]
            out = part.drop_columns(["_ok", "_series"]).append_column("dev", pa.array(np.where(np.isnan(dev), 0.0, dev)))
            yield from out.combine_chunks().to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[pa.RecordBatch] = []
            held, seen = None, 0  # rows that are still needed, of which the first ``seen`` have been handed on
            for batch in batches:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) < STEP:
                    continue
                table = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(waiting)])
                middle, last = medians(table)
                ready = max(last, table.num_rows - behind, seen)
                yield from done(table, middle, seen, ready)
                keep = max(last, ready - before)
                held, seen, waiting = table.slice(keep), ready - keep, []
            if waiting or held is not None:
                table = pa.concat_tables([*([held] if held is not None else []), *([pa.Table.from_batches(waiting)] if waiting else [])])
                if table.num_rows > seen:
                    yield from done(table, medians(table)[0], seen, table.num_rows)

        # A series is known to Python by a hash of its key; equal hashes of neighbours would need two baselines of one 64-bit hash in one task.
        given = rows.drop("_amp", "_in", "dev").withColumn("_series", F.xxhash64("baseline"))
        fields = [f for f in given.schema.fields if f.name not in ("_ok", "_series")]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "dev double"])
        return given.repartition("baseline").sortWithinPartitions("_series", "baseline", "channel").mapInArrow(run, schema)
