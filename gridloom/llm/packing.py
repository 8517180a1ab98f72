"""Arrays inside of binary columns, and blocks of 64-bit values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def block_of(x: np.ndarray, blocks: int) -> np.ndarray:
    """Even intervals of 64-bit values, so ascending values have ascending blocks."""
    return (((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def cuts(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin and, last, the end."""
    return np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]]) if len(a) else np.zeros(1, np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: ascending 64-bit hashes as differences, every array by planes of bytes, compressed."""
    out = [np.array([len(arrays)], np.int32).tobytes()]
    for a in arrays:
        raw = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a
        planes = np.ascontiguousarray(np.ascontiguousarray(raw).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
        data = pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(a) else b""
        out += [a.dtype.str.encode().ljust(4), np.array([len(a), len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    """The arrays that ``packed`` took."""
    out, at = [], 4
    for _ in range(int(np.frombuffer(raw, np.int32, 1)[0])):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        n, size = np.frombuffer(raw, np.int64, 2, at + 4).tolist()
        at += 20
        if n:
            planes = np.frombuffer(pa.decompress(raw[at : at + size], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
            a = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind)[:, 0]
        else:
            a = np.zeros(0, kind)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += size
    return out


def joined(payloads: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """Arrays of the same place in several packed values, one after another."""
    parts = [unpacked(x) for x in payloads]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]
