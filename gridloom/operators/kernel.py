"""A user's own kernel over batches of series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Series that a kernel gets at a time, at most.
ROWS = 1024


def kernel(vectors: DataFrame, run: Callable[[np.ndarray], np.ndarray], column: str = "values", out: str = "values") -> DataFrame:
    """``vectors`` with ``out``: what ``run`` makes of ``column``, an array of numbers a row.

    ``run`` gets a float64 matrix, a series a row, and returns one with as many rows; it sees runs of neighbouring rows of one length, up to ROWS,
    wherever they lie, so it must treat each row by itself. A null array stays null; null entries are NaN on the way in, and NaN
    comes back as NaN. Rows are worked on where they are: no shuffle.
    """
    keep = [c for c in vectors.columns if c != out]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("_in").cast(pa.list_(pa.float64()))
            length = np.where(given.is_valid().to_numpy(zero_copy_only=False), np.diff(given.offsets.to_numpy()), -1)
            done: list[pa.Array] = []
            at = [0, *(np.flatnonzero(np.diff(length)) + 1).tolist(), len(length)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                for low in range(a, b, ROWS):
                    part = given.slice(low, min(ROWS, b - low))
                    if length[a] < 0:
                        done.append(part)
                        continue
                    flat = part.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
                    made = np.asarray(run(flat.reshape(len(part), length[a])), np.float64)
                    if made.ndim != 2 or len(made) != len(part):
                        raise ValueError(f"the kernel made {made.shape} of {len(part)} rows")
                    ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
                    done.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel())))
            result = pa.concat_arrays(done) if done else given
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), result], names=[*keep, out])

    fields = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` array<double>"])
    return vectors.select(*keep, vectors[column].cast("array<double>").alias("_in")).mapInArrow(rows, fields)
