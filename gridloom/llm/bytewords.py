"""Words and their 64-bit hashes straight from the bytes of Arrow string columns, without a Python object per word.

A text is cut where its bytes are separators; every other byte belongs to a word. Bytes are folded through a table
of 256 entries (A-Z to a-z). A word's hash is a polynomial over its folded bytes, read from prefix sums modulo 2^64
and mixed afterwards, so a batch costs a few array passes. Work is done in slices of SLICE bytes; a longer text is
cut at separators, so memory follows the slice and the word count, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Separators: ASCII white space only.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Separators: every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _pieces(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, byte positions where texts or their parts begin, and the end): runs of whole texts of about
    SLICE bytes; a text that is longer comes in parts that end at separators."""
    first, last = 0, len(at) - 1
    while first < last:
        upto = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        if upto > first + 1 or at[upto] - at[first] <= 2 * SLICE:
            yield first, at[first : upto + 1]
        else:
            begin, end = int(at[first]), int(at[upto])
            while begin < end:
                stop = min(end, begin + SLICE)
                while stop < end:
                    gap = np.flatnonzero(separators[data[stop : min(end, stop + SLICE)]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(end, stop + SLICE)
                yield first, np.array([begin, stop], np.int64)
                begin = stop
        first = upto


def words(array, separators: np.ndarray = SPACE, tails: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes of all words in order, where each text's words begin and, last, end[, each word's last two bytes])."""
    data, at = column(array)
    hashes, tail, counts = [], [], np.zeros(len(at) - 1, np.int64)
    for first, bounds in _pieces(data, at, separators):
        raw = data[bounds[0] : bounds[-1]]
        if not len(raw):
            continue
        solid = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds - bounds[0]] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        begin = np.flatnonzero(solid & (~before | edge[:-1]))
        end = np.flatnonzero(solid & (~after | edge[1:]))
        power, inverse = _tables(len(raw))
        folded = FOLD[raw]
        sums = np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])
        under = np.where(begin > 0, sums[begin - 1], np.uint64(0))
        hashes.append(mix((sums[end] - under) * inverse[begin]))
        if tails:
            tail.append(folded[end].astype(np.int32) * 256 + np.where(end > begin, folded[np.maximum(end - 1, 0)], 0))
        counts[first : first + len(bounds) - 1] += np.diff(np.searchsorted(begin, bounds - bounds[0]))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return (out, starts, np.concatenate(tail) if tail else np.zeros(0, np.int32)) if tails else (out, starts)


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes; len(hashes) - width + 1 of them."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * _STEP + hashes[k : k + n])
    return out


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its shingle hashes in order; a text of fewer words is one shingle, an empty one has none."""
    every = chained(hashes, width)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            yield every[a : b - width + 1]
        elif b > a:
            yield chained(hashes[a:b], int(b - a))
        else:
            yield every[:0]
