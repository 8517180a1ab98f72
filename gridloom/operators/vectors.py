"""Transposition of arrays by blocks: series by baseline become series by channel, and no sample is ever a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship

#: Series of a block, channels of a block, and samples of the blocks that a task cuts at a time.
SERIES, CHANNELS, SAMPLES = 1024, 64, 1 << 22


def transpose_vectors(vectors: DataFrame, key: str = "baseline", column: str = "values", axis: str = "channel", channels: int = CHANNELS) -> DataFrame:
    """(axis, keys, values): for each place of the arrays its entries in all series, in ascending order of ``key``; ``keys`` names the series.

    ``key`` is a whole number, not null and not repeated; a shorter array is as if filled up with nulls, a null array with nothing else. Places count from 0. Each task cuts runs of SERIES
    series into blocks of ``channels`` places, already transposed; a block is one row of the only shuffle, and a task of the second step holds ``channels`` places
    of all series, or one series of output at the least. The longest array's length is looked up at once.
    """
    ship(vectors.sparkSession)
    longest = vectors.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0
    series = max(1, min(SERIES, SAMPLES // max(longest, 1)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, series):
                part = b.slice(low, series)
                ids, lists = part.column(0).to_numpy(), part.column(1)
                length = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
                flat = lists.flatten()
                have = np.zeros((len(ids), longest), bool)
                have[np.arange(longest)[None, :] < length[:, None]] = True
                matrix, known = np.zeros(have.shape), np.zeros(have.shape, bool)
                matrix[have] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
                known[have] = flat.is_valid().to_numpy(zero_copy_only=False)
                for first in range(0, longest, channels):
                    piece, there = matrix[:, first : first + channels].T, known[:, first : first + channels].T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first // channels], pa.int32()), pa.array([ids.astype(np.int64).tobytes()]), pa.array([np.ascontiguousarray(piece).tobytes()]), pa.array([np.packbits(there).tobytes()])],
                        names=["_tile", "_ids", "_data", "_known"],
                    )

    given = vectors.select(F.col(key).cast("long").alias("_id"), F.col(column).cast("array<double>").alias("_v"))
    cut_up = given.mapInArrow(blocks, "_tile int, _ids binary, _data binary, _known binary")

    def whole(tile: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.int64) for x in tile["_ids"].to_pylist()]
        width = max(len(d) // (8 * len(i)) for d, i in zip(tile["_data"].to_pylist(), ids, strict=True))
        total = sum(map(len, ids))
        values, known, at = np.zeros((width, total)), np.zeros((width, total), bool), 0
        for i, d, k in zip(ids, tile["_data"].to_pylist(), tile["_known"].to_pylist(), strict=True):
            block = np.frombuffer(d, np.float64).reshape(-1, len(i))
            values[: len(block), at : at + len(i)] = block
            known[: len(block), at : at + len(i)] = np.unpackbits(np.frombuffer(k, np.uint8), count=block.size).astype(bool).reshape(block.shape)
            at += len(i)
        every = np.concatenate(ids)
        order = np.argsort(every, kind="stable")
        ends = pa.array(np.arange(width + 1, dtype=np.int32) * total)
        names = pa.ListArray.from_arrays(ends, pa.array(np.tile(every[order], width)))
        data = pa.ListArray.from_arrays(ends, pa.array(values[:, order].ravel(), mask=~known[:, order].ravel()))
        first = tile["_tile"][0].as_py() * channels
        return pa.table({axis: pa.array(np.arange(first, first + width, dtype=np.int32)), "keys": names, "values": data})

    return cut_up.groupBy("_tile").applyInArrow(whole, f"`{axis}` int, keys array<long>, values array<double>")
