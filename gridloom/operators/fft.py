"""Batched Fourier transforms, not normalised in either direction."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORWARD, INVERSE = "forward", "inverse"
C2C, R2C, C2R = "c2c", "r2c", "c2r"


def fft(vectors: DataFrame, shape: tuple[int, ...], kind: str = C2C, mode: str = FORWARD, single: bool = False) -> DataFrame:
    """Transforms each row of (batch keys, re ARRAY[, im ARRAY]): arrays in C order over the last axes, of ``shape`` in the spatial domain.

    c2c: complex both ways; r2c (forward only): ``re`` to a half spectrum of shape[-1] // 2 + 1; c2r (inverse only):
    the half spectrum to ``re``, with ``im`` dropped. A row is transformed where it is: no shuffle.
    """
    if kind not in (C2C, R2C, C2R) or mode not in (FORWARD, INVERSE):
        raise ValueError(f"no transform {kind} {mode}")
    if (kind == R2C and mode != FORWARD) or (kind == C2R and mode != INVERSE):
        raise ValueError(f"{kind} is not {mode}")
    if not shape or min(shape) < 1:
        raise ValueError("the shape has positive sizes")
    half = (*shape[:-1], shape[-1] // 2 + 1)
    into = half if kind == C2R else shape
    keys = [c for c in vectors.columns if c not in ("re", "im")]
    needs = ["re"] if kind == R2C else ["re", "im"]
    if missing := set(needs) - set(vectors.columns):
        raise ValueError(f"no columns {sorted(missing)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axes = tuple(range(1, len(shape) + 1))
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                z = np.stack(part["re"].to_numpy()).astype(np.float64)
                if kind != R2C:
                    z = z + 1j * np.stack(part["im"].to_numpy())
                if z.shape[1] != int(np.prod(into)):
                    raise ValueError(f"rows of {z.shape[1]} samples, not {into}")
                z = z.reshape(len(z), *into)
                if kind == R2C:
                    z = np.fft.rfftn(z, axes=axes)
                elif kind == C2R:
                    z = np.fft.irfftn(z, s=shape, axes=axes, norm="forward")
                else:
                    z = np.fft.fftn(z, axes=axes) if mode == FORWARD else np.fft.ifftn(z, axes=axes, norm="forward")
                z = z.reshape(len(z), -1)
                if single:
                    z = z.astype(np.float32 if kind == C2R else np.complex64)
                out = part[keys].copy()
                out["re"] = list(z.real.astype(np.float64))
                if kind != C2R:
                    out["im"] = list(z.imag.astype(np.float64))
                yield out

    fields = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keys] + ["re array<double>"] + (["im array<double>"] if kind != C2R else [])
    return vectors.select(*keys, *needs).mapInPandas(run, ", ".join(fields))


def dft_power(grid: DataFrame, length: int, key: str = "baseline", axis: str = "channel", value: str = "value") -> DataFrame:
    """(baseline, k, power) of the half spectrum of short real series, by sums of products alone: each sample meets every k, and sums are
    combined before the shuffle."""
    rows = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = F.lit(2 * pi / length) * F.col("k") * F.col(axis)
    sums = rows.groupBy(key, "k").agg(F.sum(F.col(value) * F.cos(angle)).alias("_c"), F.sum(F.col(value) * F.sin(angle)).alias("_s"))
    return sums.select(key, "k", (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")).alias("power"))

