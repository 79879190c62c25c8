"""Vectorised byte and word kernels shared by the text operators.

Everything works on UTF-8 bytes in numpy, many documents at a time, straight on the
buffers of an Arrow string column.  Hashes are 64-bit: a keyed polynomial over bytes,
finished by a bijective mixer.  Two different strings among n collide with a chance
of about n * n / 2**65.
"""

from __future__ import annotations

import ctypes
import functools
import sys

import numpy as np

U = np.uint64
#: Bytes of text that are handled at once; bounds the temporary arrays (some 60 bytes per byte).
CHUNK = 1 << 19

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)


def releasing(rows):
    """A function over Arrow batches that, when it has seen them all, gives freed memory back to the system:
    workers live on between stages."""

    @functools.wraps(rows)
    def run(batches):
        yield from rows(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919 + 13))


_KEYS = byte_keys(1)
_KEYS2 = byte_keys(2)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, CHUNK + 1024)
        with np.errstate(over="ignore"):
            p = np.full(size, U(_MULT))
            p[0] = 1
            q = np.full(size, U(_INV))
            q[0] = 1
            np.cumprod(p, out=p)
            np.cumprod(q, out=q)
        _POW["p"], _POW["q"] = p, q
    return _POW["p"], _POW["q"]


def prefix_hash(data: np.ndarray, keys: np.ndarray = _KEYS) -> np.ndarray:
    """h[i]: polynomial hash of data[:i] (n + 1 values)."""
    p, _ = _powers(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=U)
    with np.errstate(over="ignore"):
        np.cumsum(keys[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from prefix_hash; equal bytes give equal values wherever they lie."""
    _, q = _powers(len(h))
    with np.errstate(over="ignore"):
        return mix((h[end] - h[start]) * q[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (bytes outside 9-13 and 32) and, per document, the index
    of its first word (one more value than documents).  bounds: document offsets into data."""
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    if n:
        last[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased data, and each document's first word index."""
    start, end, firsts = word_spans(data, bounds)
    return span_hash(prefix_hash(data), start, end), firsts


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a (chunked) Arrow string or binary array; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], (off - off[0]) if len(off) else np.zeros(1, np.int64)


def chunks(bounds: np.ndarray, size: int = CHUNK):
    """Ranges (i, j) of whole documents with about `size` bytes each; a longer document is alone."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def group_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sum of values[firsts[k]:firsts[k + 1]] for each k (empty groups give 0)."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
