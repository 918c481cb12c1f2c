"""Numpy views of Arrow text columns, shared by the operators of this folder.

All functions work on one Arrow batch inside a Spark task; nothing here knows about Spark.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: One random 64-bit value per byte.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)


def give_back() -> None:
    """What Arrow's pool and, with glibc, the heap hold unused goes back to the system, as a worker may stay idle for long."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch whose texts have about ``limit`` bytes together; a longer text is alone in its slice."""
    _, offsets = text_bytes(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, U64)
        out[0], filled, step = 1, 1, base
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * U64(step)
            filled, step = 2 * filled, step * step % (1 << 64)
        _POWERS[base] = have = out
    return have[:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for every span, from one running sum; equal spans hash alike."""
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(BASE, len(codes)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(codes) + 1)[starts]
    return mix(hashes + (ends - starts).astype(U64) * U64(0xD1B54A32D192ED03))


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


#: Bytes 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay within a text: (starts, ends, number of runs before each text)."""
    n = len(member)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+`` of every text."""
    return runs(~IS_SPACE[raw], offsets)


def lengths_to_rows(counts: np.ndarray) -> np.ndarray:
    """0 repeated counts[0] times, 1 repeated counts[1] times, ..."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)
