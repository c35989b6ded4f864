"""Vectorised views of text batches: words, word hashes and shingle hashes.

A batch of texts is one byte buffer with document offsets; everything here
works on whole buffers with numpy, so no Python code runs per character.
Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers of the words of a window; as many as the widest window.
_POSITION = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
             0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a task, after which the worker gives back memory that it no longer uses; workers live on into other stages."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _powers.cache_clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidied


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one offset more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(column: pa.Array, limit: int = 1 << 20):
    """Row ranges whose texts together hold about `limit` bytes; a longer text stands alone."""
    n = len(column)
    if not n:
        return
    lengths = np.asarray(pc.binary_length(column.fill_null("")), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run without white space, within one text), and words before each text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    full = ~WHITE[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(full[:-1], out=first[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(full[1:], out=last[:-1])
    last[inner - 1] = True
    starts = np.flatnonzero(first & full)
    ends = np.flatnonzero(last & full) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a buffer that are hashed at a time; only a longer single range takes more.
_STRETCH = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, given in order of their starts; equal ranges get equal hashes in every batch."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + _STRETCH)))
        low, high = int(starts[a]), int(ends[a:b].max())
        up, down = _powers(max(19, (high - low).bit_length()))
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=total[1:])
        size = ends[a:b] - starts[a:b]
        out[a:b] = mix64((total[ends[a:b] - low] - total[starts[a:b] - low]) * down[starts[a:b] - low] + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        a = b
    return out


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes; they may span texts, callers drop those."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _U(_POSITION[0])
    for k in range(1, width):
        total = total + h[k : k + n] * _U(_POSITION[k])
    return mix64(total)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles, A-Z lower-cased.

    A text with fewer words than `width` has its whole word sequence as one
    shingle; a text without words has none.
    """
    data, offsets = text_buffer(column)
    data = LOWER[data]
    starts, ends, before = words(data, offsets)
    h = span_hashes(data, starts, ends)
    w = window_hashes(h, width)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            s = np.sort(w[a : b - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif b > a:
            short = (h[a:b] * np.array(_POSITION[: b - a], np.uint64)).sum(dtype=np.uint64)
            out.append(mix64(np.array([short + _U(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
