"""A user's fold, combined before the shuffle: partial folds of every row's samples in each task, then merges of the partial results.

The fold works on whole arrays: samples of a batch are put in order of their row, and neighbours of one row are combined pairwise, all rows at once, until one value a row is left. A
task keeps one value for each row it has met, up to HELD rows; so a row costs the shuffle one value a task (more only where a task meets more than HELD rows), however
many samples it has, and no list of samples is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.operators.reduce import _in_range

#: Rows of which a task keeps a partial result.
HELD = 1 << 18
Fold = Callable[[np.ndarray, np.ndarray], np.ndarray]


def folded(values: np.ndarray, starts: np.ndarray, op: Fold) -> np.ndarray:
    """One value for each stretch of ``values`` from starts[k] to starts[k + 1]; none is empty. Neighbours are combined, then neighbours of what is left."""
    while len(values) > len(starts) - 1:
        length = np.diff(starts)
        place = np.arange(len(values)) - np.repeat(starts[:-1], length)
        last = np.repeat(length, length) - 1
        first = place % 2 == 0
        pair = np.flatnonzero(first & (place < last))
        made = values.copy()
        if len(pair):
            made[pair] = op(values[pair], values[pair + 1])
        values = made[first]
        starts = np.concatenate([[0], np.cumsum((length + 1) // 2)])
    return values


def _merged(keys: pa.Array, values: np.ndarray, op: Fold) -> tuple[pa.Array, np.ndarray]:
    """Each key once, with the fold of its values."""
    codes = keys.dictionary_encode(null_encoding="encode")
    at = codes.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    edge = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    starts = np.append(np.flatnonzero(edge), len(ranked))
    return codes.dictionary.take(pa.array(ranked[edge])), folded(values[order], starts, op)


def fold(
    grid: DataFrame, op: Fold, identity, rows: str = "row", columns: str = "col", value: str = "value", column_range: tuple[int, int] | None = None, size: int | None = None,
) -> DataFrame:
    """(row, value): each row's samples in [start, stop) of its columns folded by ``op``, a function of two NumPy arrays of the value's type that combines them entry by entry.

    ``op`` is commutative and associative; samples are combined in no particular order, and null samples count as ``identity``. ``row`` has a type that Arrow can put into a dictionary: a number, a
    string, a date. A row whose samples are all null is ``identity``; null is a row like others; without samples there is no row.
    """
    ship(grid.sparkSession)
    part = _in_range(grid, columns, column_range, size).select(rows, value)
    kind = part.schema[value].dataType.simpleString()
    schema = f"`{rows}` {part.schema[rows].dataType.simpleString()}, `{value}` {kind}"

    def batch(keys: pa.Array, values: np.ndarray, like: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.cast(like.field(0).type), pa.array(values).cast(like.field(1).type)], schema=like)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, like = None, None, None
        for b in batches:
            like = b.schema
            given = b.column(1).fill_null(pa.scalar(identity).cast(b.column(1).type)).to_numpy(zero_copy_only=False)
            k, v = _merged(b.column(0), given, op)
            keys, values = (k, v) if keys is None else _merged(pa.concat_arrays([keys, k]), np.concatenate([values, v]), op)
            if len(keys) > HELD:
                yield batch(keys, values, like)
                keys = None
        if keys is not None:
            yield batch(keys, values, like)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial results in order of their row: all but the last row of a batch are whole."""
        keys, values, like = None, None, None
        for b in batches:
            like = b.schema
            if not b.num_rows:
                continue
            k, v = _merged(b.column(0), b.column(1).to_numpy(zero_copy_only=False), op)
            keys, values = (k, v) if keys is None else _merged(pa.concat_arrays([keys, k]), np.concatenate([values, v]), op)
            if len(keys) > 1:
                yield batch(keys.slice(0, len(keys) - 1), values[:-1], like)
                keys, values = keys.slice(len(keys) - 1), values[-1:]
        if keys is not None:
            yield batch(keys, values, like)

    partials = part.mapInArrow(partial, schema)
    return partials.repartition(F.col(rows)).sortWithinPartitions(rows).mapInArrow(merge, schema)
