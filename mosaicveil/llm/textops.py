"""Vectorised words, shingles and hashes over Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give freed memory back at the end of a task; the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on unsigned 64-bit words."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BYTE_LOWER = _BYTE[LOWER].copy()
_BYTE_LOWER[_WS] = 0
_BASE = U64(0x9E3779B97F4A7C15)
_STEP = mix(np.arange(101, 106, dtype=U64)) | U64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, most_bytes: int = 4 << 20, most_rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a longer text makes a run of its own."""
    buf, offs = buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most_bytes, "right")) - 1
        end = min(max(end, at + 1), at + most_rows, n)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes other than space and tab to carriage return."""
    solid = ~_WS[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offs[:-1][np.diff(offs) > 0]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    finals = offs[1:][np.diff(offs) > 0] - 1
    last[finals] = solid[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_POWERS = [np.ones(1, U64)]


def powers(n: int) -> np.ndarray:
    have = _POWERS[0]
    if len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[0] = have = np.cumprod(np.r_[U64(1), np.full(size - 1, _BASE, U64)])
    return have


#: Bytes that are hashed at once; what a hash needs on the way is some 50 times as much.
_PIECE = 1 << 19


def _sums(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    size = ends - starts
    flat = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # place within the word
    value = code[buf[np.repeat(starts, size) + flat]]
    return np.add.reduceat(value * powers(int(size.max()))[flat], np.cumsum(size) - size)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z as a-z if lower. Goes by pieces of bounded size, also through a single huge word."""
    code, out = _BYTE_LOWER if lower else _BYTE, np.zeros(len(starts), U64)
    total = np.r_[0, np.cumsum(ends - starts)]
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(total, total[at] + _PIECE, "right")) - 1)
            if total[end] - total[at] <= _PIECE:
                out[at:end] = _sums(buf, starts[at:end], ends[at:end], code)
            else:
                step, scale = powers(_PIECE + 1)[_PIECE], U64(1)
                for a in range(int(starts[at]), int(ends[at]), _PIECE):
                    b = min(a + _PIECE, int(ends[at]))
                    out[at] += scale * _sums(buf, np.array([a]), np.array([b]), code)[0]
                    scale = scale * step
            at = end
        return mix(out + U64(1))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; a row of fewer words (but one at least) is a single shingle."""
    with np.errstate(over="ignore"):
        n = len(words)
        padded = np.r_[words, np.zeros(k, U64)]
        total = np.zeros(n, U64)
        for j in range(k):
            total += padded[j : n + j] * _STEP[j]
        full = np.zeros(n, bool)
        if n >= k:
            full[: n - k + 1] = rows[: n - k + 1] == rows[k - 1 :]
        count = np.bincount(rows, minlength=n_rows)
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < k))
        part = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = count[short] > j
            part[has] += words[first[short][has] + j] * _STEP[j]
        out, where = np.r_[total[full], part], np.r_[rows[full], short]
        return mix(out), where
