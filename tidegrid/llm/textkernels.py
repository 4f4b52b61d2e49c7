"""Vectorised word and shingle hashing over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, _BLOCK + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its rows' offsets into them; null: empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ranges(column: pa.Array, size: int) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row has one of its own."""
    _, offsets = buffers(column)
    out, a = [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (with an end mark)."""
    gap = _SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = ~gap[inner]  # a row's first byte starts a word even right after another row's last
    starts = np.flatnonzero(begins)
    stops = gap.copy()
    stops[inner] = True
    where = np.flatnonzero(stops)
    if len(starts):
        k = np.searchsorted(where, starts, "right")
        ends = np.where(k < len(where), where[np.minimum(k, max(0, len(where) - 1))] if len(where) else len(data), len(data))
    else:
        ends = starts
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z as a-z if lower), block by block; the starts ascend."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _BLOCK)))
        lo, hi = int(starts[a]), int(ends[a:b].max())
        up, down = powers(hi - lo + 1)
        part = data[lo:hi]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(((_LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all size-word shingles and each row's first one (with an end mark).

    A row of fewer words, but one at least, has its whole sequence as one.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate(([0], np.cumsum(made)))
    rows = np.repeat(np.arange(len(counts)), made)
    at = first[:-1][rows] + np.arange(begin[-1]) - begin[:-1][rows]
    left = first[1:][rows] - at
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = left > k
        word = hashes[np.minimum(at + k, max(0, len(hashes) - 1))] if len(hashes) else value
        value = np.where(there, mix(value * np.uint64(0x9DDFEA08EB382D69) + word), value)
    return value, begin
