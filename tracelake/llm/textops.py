"""Vectorised byte-level text helpers for Arrow batches: blocks, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (fixed values).
IS_SPACE_WORD = np.ones(256, bool)
IS_SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
IS_ALNUM_WORD = np.ones(256, bool)
IS_ALNUM_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def byte_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of consecutive rows: first row, end row, bytes, offsets (from 0). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i])
        i = j


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES + 1), base, _U)
        full[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(full)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, so that any substring's hash follows from two of them."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), _PINV)[start]
    return mix(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    m = is_word[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = offs[1:-1]
    at = inner[inner < len(data)]
    first[at] = m[at]
    at = inner[inner > 0] - 1
    last[at] = m[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def segments(ptr: np.ndarray) -> np.ndarray:
    """The row of each element, for rows that hold elements ptr[i] to ptr[i+1]."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U(size), _U)
    for k in range(size):
        out = out * _U(0x9FB21C651E98DF25) + h[k : k + n]
    return mix(out)
