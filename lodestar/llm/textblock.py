"""Vectorised views of text columns: words, lines and hashes straight from Arrow buffers.

A batch of texts is one byte array plus document bounds. Words are runs of bytes other than 0x20 and 0x09-0x0D;
those bytes never occur inside a multi-byte UTF-8 character, so byte words equal code-point words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:  # large arrays go back to the system as soon as they are freed, which keeps workers small
    _libc = ctypes.CDLL(None)
    _libc.mallopt(-3, 1 << 20)
except (AttributeError, OSError):  # another C library
    _libc = None
pa.set_memory_pool(pa.system_memory_pool())


def release_memory() -> None:
    """Gives what is free in this process back to the system."""
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


PIECE = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, is_null) of a string column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    null = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds, null


def pieces(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    n, lo = len(bounds) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of ``data``, and for each document the index of its first word (one more at the end).

    ``bounds`` must begin at 0 and end at ``len(data)``.
    """
    word = ~WHITE[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        filled = bounds[1:] > bounds[:-1]
        head, tail = bounds[:-1][filled], bounds[1:][filled] - 1
        first[head] = word[head]
        last[tail] = word[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_power = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(max(n, 1 << 16), base, U64)
            steps[0] = 1
            _power[k] = np.cumprod(steps)
    return _power[0], _power[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, equal for equal bytes wherever they stand (A-Z as a-z if ``lower``)."""
    out = np.empty(len(starts), U64)
    byte = _BYTE[LOWER] if lower else _BYTE
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        size = int(ends[hi - 1] - at)
        up, down = _powers(size)
        sums = np.zeros(size + 1, U64)
        np.cumsum(byte[data[at : at + size]] * up[:size], out=sums[1:])
        s = starts[lo:hi] - at
        out[lo:hi] = (sums[ends[lo:hi] - at] - sums[s]) * down[s]
        lo = hi
    return mix(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` consecutive words of one sequence."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(width):
        total += words[k : k + n] * U64((0xA0761D6478BD642F * (2 * k + 3)) % (1 << 64) | 1)
    return mix(total)


def code_points(data: np.ndarray) -> np.ndarray:
    """Code-point index of each byte's character, and one more: positions in code points from byte positions."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def sorted_groups(batches, keys: list[str]):
    """Tables of the rows with equal keys (without nulls), of batches sorted by these."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            column = rows.column(k).to_numpy()
            new |= column[1:] != column[:-1]
        edge = [0, *(np.flatnonzero(new) + 1).tolist()]
        for lo, hi in zip(edge, edge[1:], strict=False):
            yield rows.slice(lo, hi - lo)
        rest = rows.slice(edge[-1])
    if rest is not None and rest.num_rows:
        yield rest
