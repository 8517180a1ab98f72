"""The .npy file source."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Samples that a task hands on at a time.
_STEP = 1 << 18


def read_npy(spark: SparkSession, path: str, axes: tuple[str, ...] = ("time", "channel", "baseline")) -> DataFrame:
    """Arrays in .npy files as LONG grids: ``file``, the given index columns, then ``re`` and ``im`` (0 for real arrays).

    ``path`` may name one file, a folder or a pattern; each file is one task. Another extension is a ValueError, an array of another rank fails the job.
    """
    if not path.endswith((".npy", "/", "*")):
        raise ValueError(f"{path}: only .npy files are read")
    names = ["file", *axes, "re", "im"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                if array.ndim != len(axes):
                    raise ValueError(f"{name}: {array.ndim} axes, not {len(axes)}")
                flat = array.reshape(-1)
                for low in range(0, len(flat), _STEP):
                    part = flat[low : low + _STEP]
                    index = np.unravel_index(np.arange(low, low + len(part)), array.shape)
                    data = {"file": name, **{a: x.astype(np.int32) for a, x in zip(axes, index, strict=True)}, "re": part.real.astype(np.float64), "im": part.imag.astype(np.float64)}
                    yield pd.DataFrame(data)[names]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    schema = "file string, " + ", ".join(f"{a} int" for a in axes) + ", re double, im double"
    return files.mapInPandas(parse, schema)
