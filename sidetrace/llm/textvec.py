"""Words, word hashes and n-gram hashes of whole Arrow text columns, by numpy on the raw UTF-8 bytes.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text worked on at once; a longer text is one block.
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + (1 << 12))
        for i, x in enumerate((_BASE, _INVERSE)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts of about BLOCK bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        yield i, j - i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, case kept."""
    power, inverse = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word in order, and for each text the index of its first word (one more at the end)."""
    h, first, _ = words_and_parts(data, offsets)
    return h, first


def words_and_parts(data: np.ndarray, offsets: np.ndarray, starts: tuple[int, ...] = (), ends: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """words, and hashes of the first or last so many bytes of each word, one array for each length; a shorter word is its own part."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), [np.zeros(0, np.uint64)] * (len(starts) + len(ends))
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power, out=total[1:])

    def span(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _STEP + np.uint64(kind))

    parts = [span(start, np.minimum(start + k, end), k << 8) for k in starts] + [span(np.maximum(end - k, start), end, k << 16) for k in ends]
    return span(start, end, 0), np.searchsorted(start, offsets).astype(np.int64), parts


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and for each text the index of its first; a text of fewer words has one, of all its words; without words none."""
    k, size = len(h), np.diff(first)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(count, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint64)
    if k >= n:
        g = h[: k - n + 1].copy()
        for i in range(1, n):
            g *= _BASE
            g += h[i : k - n + 1 + i]
        keep = np.zeros(k - n + 1, bool)
        text = np.repeat(np.arange(len(size)), size)[: k - n + 1]
        keep = np.arange(k - n + 1) + n <= first[1:][text]
        full = np.repeat(size >= n, count)
        out[full] = mix(g[keep] + np.uint64(n))
    for i in np.flatnonzero((size > 0) & (size < n)):
        g = np.uint64(0)
        for x in h[first[i] : first[i + 1]]:
            g = np.uint64((int(g) * int(_BASE) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[at[i]] = mix(np.array([g + np.uint64(0)], np.uint64) + np.uint64(size[i]))[0]
    return out, at


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
