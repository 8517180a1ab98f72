"""``.npy`` arrays as a data source: byte ranges of a file are read by many tasks, and an index range reads only its bytes.

``spark.read.format("npy")`` after ``register(spark)``, or ``scan_npy``. Options: ``path`` (a file or a folder, in any file system that pyarrow knows by its URI),
``axes`` (names, comma-separated), ``where.<axis>`` ("start:stop"), ``bytes`` (of a partition). Comparisons of axes in a filter narrow the ranges too. ``spark.write.format("npy")`` writes rows with one array column, an array a task, which appear together when all tasks are done.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from gridloom.cluster import ship
from gridloom.sources.store_writer import make, opened, remove

#: Bytes of a partition; bytes that a task reads at a time.
PART, READ = 128 << 20, 4 << 20
_CLOSED = {"LessThan": (0, 0), "LessThanOrEqual": (0, 1), "GreaterThan": (1, 1), "GreaterThanOrEqual": (1, 0), "EqualTo": (2, 0)}


@dataclass(frozen=True)
class Header:
    """Where an array's data begin, and how: ``shape`` in the order of the data, outermost first; ``flipped`` if that is the array's reversed."""

    start: int
    shape: tuple[int, ...]
    dtype: np.dtype
    flipped: bool


def read_header(path: str) -> Header:
    """The header alone is read. Arrays of Python objects and records are a ValueError."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        head = io.BytesIO(f.read(10))
        version = np.lib.format.read_magic(head)
        f.seek(8)
        size = int.from_bytes(f.read(2 if version == (1, 0) else 4), "little")
        head = io.BytesIO(size.to_bytes(2 if version == (1, 0) else 4, "little") + f.read(size))
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format")
        shape, flipped, dtype = read(head)
        if dtype.kind not in "biufc":
            raise ValueError(f"{path}: {dtype} is no number")
        return Header(f.tell(), tuple(reversed(shape)) if flipped else tuple(shape), dtype, flipped)


@dataclass(frozen=True)
class Box(ds.InputPartition):
    """A range of every axis of one file."""

    path: str
    header: Header
    ranges: tuple[tuple[int, int], ...]
    value: int = field(default=0)


def boxes(path: str, header: Header, ranges: list[tuple[int, int]], limit: int) -> Iterator[Box]:
    """``ranges`` in boxes of about ``limit`` bytes: the outermost axis is divided, and the next ones where one step of it is still too much."""
    size = header.dtype.itemsize * int(np.prod([max(0, b - a) for a, b in ranges], dtype=object))
    if size <= 0:
        return
    axis = next((k for k, (a, b) in enumerate(ranges) if b - a > 1), None)
    if size <= limit or axis is None:
        yield Box(path, header, tuple(ranges))
        return
    low, high = ranges[axis]
    step = max(1, (high - low) * limit // size)
    for a in range(low, high, step):
        yield from boxes(path, header, [*ranges[:axis], (a, min(a + step, high)), *ranges[axis + 1 :]], limit)


def spans(box: Box, limit: int = READ) -> Iterator[tuple[tuple[tuple[int, int], ...], int, int]]:
    """(ranges, first byte, bytes) of the reads of a box, about ``limit`` bytes at most if the innermost axis allows.

    A read takes all from its first to its last element, so ranges are divided along the outer axes until that is no more than what is wanted, or small.
    """
    shape, item = box.header.shape, box.header.dtype.itemsize
    strides = [item * int(np.prod(shape[k + 1 :], dtype=object)) for k in range(len(shape))]

    def cover(ranges: tuple[tuple[int, int], ...]) -> tuple[int, int]:
        first = sum(a * s for (a, _), s in zip(ranges, strides, strict=True))
        return first, sum((b - 1 - a) * s for (a, b), s in zip(ranges, strides, strict=True)) + item

    def divided(ranges: tuple[tuple[int, int], ...]) -> Iterator[tuple[tuple[tuple[int, int], ...], int, int]]:
        first, size = cover(ranges)
        wanted = item * int(np.prod([b - a for a, b in ranges], dtype=object))
        axis = next((k for k, (a, b) in enumerate(ranges) if b - a > 1), None)
        if axis is None or (size <= limit and (size == wanted or size <= 1 << 16)):
            yield ranges, box.header.start + first, size
            return
        low, high = ranges[axis]
        dense = size == wanted
        step = max(1, (high - low) * limit // size) if dense else max(1, (1 << 16) // strides[axis])
        for a in range(low, high, step):
            yield from divided((*ranges[:axis], (a, min(a + step, high)), *ranges[axis + 1 :]))

    yield from divided(box.ranges)


class NpyReader(ds.DataSourceReader):
    def __init__(self, options: Mapping[str, str], axes: list[str]):
        self.path, self.axes, self.limit = options["path"], axes, int(options.get("bytes", PART))
        self.ranges: dict[str, tuple[int, int]] = {a: (0, 1 << 62) for a in axes}
        for axis in axes:
            if said := options.get(f"where.{axis}"):
                low, _, high = said.partition(":")
                self._narrow(axis, int(low or 0), int(high) if high else 1 << 62)

    def _narrow(self, axis: str, low: int, high: int) -> None:
        a, b = self.ranges[axis]
        self.ranges[axis] = (max(a, low), min(b, high))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", ())
            if kind not in _CLOSED or len(column) != 1 or column[0] not in self.ranges or not isinstance(f.value, int):
                yield f
                continue
            side, extra = _CLOSED[kind]
            self._narrow(column[0], f.value + extra if side else 0, f.value + 1 if side == 2 else f.value + extra if not side else 1 << 62)

    def files(self) -> list[str]:
        system, at = opened(self.path)
        info = system.get_file_info(at)
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else "file://"
        if info.type == fs.FileType.Directory:
            found = sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".npy") and "/_" not in x.path[len(at) :])
            return [prefix + x for x in found]
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        if not at.endswith(".npy"):
            raise ValueError(f"{self.path}: only .npy files are read")
        return [self.path]

    def partitions(self) -> list[Box]:
        out = []
        for path in self.files():
            header = read_header(path)
            if len(header.shape) != len(self.axes):
                raise ValueError(f"{path}: {len(header.shape)} axes, not {len(self.axes)}")
            names = self.axes[::-1] if header.flipped else self.axes
            ranges = [(min(max(0, self.ranges[a][0]), n), min(self.ranges[a][1], n)) for a, n in zip(names, header.shape, strict=True)]
            out += boxes(path, header, ranges, self.limit)
        return out

    def read(self, box: Box | None) -> Iterator[pa.RecordBatch]:
        if box is None:
            return
        names = self.axes[::-1] if box.header.flipped else self.axes
        system, at = opened(box.path)
        with system.open_input_file(at) as f:
            for ranges, first, size in spans(box):
                f.seek(first)
                flat = np.frombuffer(f.read(size), box.header.dtype)
                index = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(a, b) for a, b in ranges], indexing="ij")]) if ranges else np.zeros((0, 1), np.int64)
                place, stride = np.zeros(index.shape[1], np.int64), 1
                for k in range(len(ranges) - 1, -1, -1):
                    place += (index[k] - ranges[k][0]) * stride
                    stride *= box.header.shape[k]
                value = flat[place]
                by_name = dict(zip(names, index, strict=True))
                columns = [pa.array([box.path] * len(value)), *(pa.array(by_name[a].astype(np.int64)) for a in self.axes), pa.array(value.real.astype(np.float64)), pa.array(value.imag.astype(np.float64) if value.dtype.kind == "c" else np.zeros(len(value)))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", *self.axes, "re", "im"])


@dataclass
class Written(ds.WriterCommitMessage):
    path: str | None


class NpyWriter(ds.DataSourceWriter):
    """A task's arrays, all of one length, are one file; files stand beside the target until all tasks are done, then move, or go."""

    def __init__(self, options: Mapping[str, str], schema: T.StructType, overwrite: bool):
        if len(schema) != 1 or not isinstance(schema[0].dataType, T.ArrayType):
            raise ValueError("rows have one column, an array of numbers")
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.aside = f"{self.path}/_{self.run}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        given = [r[0] for r in rows]
        if not given:
            return Written(None)
        if any(x is None for x in given) or len({len(x) for x in given}) != 1:
            raise ValueError("arrays of a file have one length, and none is null")
        system, at = opened(self.aside)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.npy"
        out = io.BytesIO()
        np.save(out, np.array(given, np.float64))
        with system.open_output_stream(f"{at}/{name}") as f:
            f.write(out.getbuffer())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.path.endswith(".npy")] if self.overwrite else []
        for m in messages:
            if m is not None and m.path:
                system.move(f"{at}/_{self.run}/{m.path}", f"{at}/{self.run[:8]}-{m.path}")
        for x in old:
            system.delete_file(x)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        remove(self.aside)


class NpySource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def _axes(self) -> list[str]:
        return [x.strip() for x in self.options.get("axes", "time,channel,baseline").split(",") if x.strip()]

    def schema(self) -> T.StructType:
        fields = [T.StructField("file", T.StringType()), *(T.StructField(a, T.LongType()) for a in self._axes())]
        return T.StructType([*fields, T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def reader(self, schema: T.StructType) -> NpyReader:
        return NpyReader(self.options, self._axes())

    def writer(self, schema: T.StructType, overwrite: bool) -> NpyWriter:
        writer = NpyWriter(self.options, schema, overwrite)
        make(writer.aside)
        return writer


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and filters of sources in Python, which this one takes."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NpySource)


def scan_npy(spark: SparkSession, path: str, axes: Iterable[str] = ("time", "channel", "baseline"), where: Mapping[str, tuple[int, int]] | None = None, part: int = PART) -> DataFrame:
    """``file``, the axes (long), ``re``, ``im``: a row a sample of the arrays at ``path``, of the index ranges in ``where`` only; partitions of ``part`` bytes."""
    axes = list(axes)
    if unknown := set(where or {}) - set(axes):
        raise ValueError(f"no axes {sorted(unknown)}")
    register(spark)
    reader = spark.read.format("npy").option("axes", ",".join(axes)).option("bytes", part)
    for axis, (low, high) in (where or {}).items():
        reader = reader.option(f"where.{axis}", f"{low}:{high}")
    return reader.load(path)
