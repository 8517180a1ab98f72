"""A versioned table written through a data source: a version appears whole or not at all, and only on top of the version it was made from.

A table at a path has folders ``version=0``, ``version=1``, ... of Parquet files. Tasks write files into a folder beside them; the commit moves that folder to the next
version's name, which fails where another writer has been first, since a folder with files in it is never replaced. So of writers that began at the same version one
wins, and the others fail with ``Conflict`` and leave nothing. A task or driver that is lost leaves at most a folder that no reader looks at.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from gridloom.cluster import ship


class Conflict(RuntimeError):
    """Another version has been written meanwhile."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make(path: str) -> None:
    """A folder for a job's tasks, made by the driver: a task that is still running when the folder is removed finds none to write to."""
    system, at = opened(path)
    system.create_dir(at, recursive=True)


def remove(path: str) -> None:
    """Removes the folder, if it is there; again where a task that is still running puts a file into it meanwhile."""
    system, at = opened(path)
    for attempt in range(20):
        try:
            if system.get_file_info(at).type == fs.FileType.Directory:
                system.delete_dir(at)
            return
        except OSError:
            if attempt == 19:
                raise
            time.sleep(0.1)


def latest(path: str) -> int:
    """The last version at ``path``, -1 without any."""
    system, at = opened(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return -1
    found = [re.fullmatch(r"version=(\d+)", x.base_name) for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.Directory]
    return max((int(m[1]) for m in found if m), default=-1)


@dataclass
class Part(ds.WriterCommitMessage):
    name: str


class VersionWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str]):
        self.path, self.on = options["path"].rstrip("/"), int(options["on"])
        self.aside = f"{self.path}/_{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, at = opened(self.aside)
        # An attempt that fails or is repeated has a file of its own; only files that are named to the commit stay.
        name, writer = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet", None
        with system.open_output_stream(f"{at}/{name}") as f:
            for batch in batches:
                writer = writer or pq.ParquetWriter(f, batch.schema, compression="zstd")
                writer.write_batch(batch)
            if writer:
                writer.close()
        return Part(name if writer else "")

    def commit(self, messages: list[Part | None]) -> None:
        system, at = opened(self.aside)
        named = {m.name for m in messages if m is not None and m.name}
        for x in system.get_file_info(fs.FileSelector(at)):
            if x.base_name not in named:
                system.delete_file(x.path)
        target = f"{opened(self.path)[1]}/version={self.on + 1}"
        try:
            if latest(self.path) != self.on:
                raise Conflict(f"{self.path}: version {self.on + 1} is there already")
            if not named:
                raise ValueError("no rows to write")
            try:
                system.move(at, target)
            except OSError as e:
                raise Conflict(f"{self.path}: version {self.on + 1} is there already") from e
        except Exception:
            self.abort(messages)
            raise

    def abort(self, messages: list[Part | None]) -> None:
        remove(self.aside)


class VersionSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom_versions"

    def writer(self, schema: T.StructType, overwrite: bool) -> VersionWriter:
        writer = VersionWriter(self.options)
        make(writer.aside)
        return writer


def write_version(rows: DataFrame, path: str, on: int) -> None:
    """Writes ``rows`` as the version after ``on``; ``Conflict`` (inside of Spark's error) if another one came between."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(VersionSource)
    try:
        rows.write.format("gridloom_versions").option("on", on).mode("append").save(path)
    except Exception as e:
        if "Conflict" in str(e):
            raise Conflict(f"{path}: version {on + 1} is there already") from e
        raise


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, the last one unless given."""
    version = latest(path) if version is None else version
    if version < 0:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")
