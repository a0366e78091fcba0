"""Vectorised text kernels over Arrow columns; all work in bounded chunks of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that part words: space, tab, newline, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random odd 64-bit value of each byte; separators count nothing.
_BYTE = _rng.integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BYTE[_SPACE] = 0
_SHINGLE = _rng.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)
_STEP = int(_rng.integers(0, 2**63)) * 2 + 1
_powers = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers), 256), U64(_STEP))
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; a longer document comes alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word of a chunk, and the word offsets of its documents.

    A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as a-z."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < n]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:]
    tails = tails[tails > 0] - 1
    last[tails] |= inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(start) == 0:
        return np.zeros(0, U64), start, end, np.zeros(len(off), np.int64)
    lens = end - start
    place = np.arange(n, dtype=np.int64)
    gaps = np.diff(np.append(start, n))
    place[start[0] :] -= np.repeat(start, gaps)
    power = _power(int(lens.max()) + 1)
    place[~inside] = 0
    if start[0]:
        place[: start[0]] = 0
    value = _BYTE[_LOWER[data] if lower else data] * power[place]
    h = mix(np.add.reduceat(value, start) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))
    return h, start, end, np.searchsorted(start, off).astype(np.int64)


def shingles(h: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, document after document, and their offsets.

    A document with 1 to n-1 words has its whole sequence as its one shingle."""
    counts = np.diff(off)
    size = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    if len(h) == 0:
        return np.zeros(0, U64), out_off
    full = len(h) - n + 1
    if full > 0:
        s = h[:full] * _SHINGLE[0]
        for j in range(1, n):
            s = s + h[j : j + full] * _SHINGLE[j]
        keep = np.zeros(full + 1, np.int64)
        lo, hi = off[:-1][counts >= n], (off[1:] - n + 1)[counts >= n]
        np.add.at(keep, lo, 1)
        np.add.at(keep, hi, -1)
        kept = s[np.cumsum(keep[:-1]) > 0]
    else:
        kept = np.zeros(0, U64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    out = np.empty(out_off[-1], U64)
    is_short = np.zeros(out_off[-1], bool)
    is_short[out_off[short]] = True
    out[~is_short] = kept
    for d in short:
        v = U64(0)
        with np.errstate(over="ignore"):
            for j, x in enumerate(h[off[d] : off[d + 1]]):
                v += x * _SHINGLE[j]
            v += U64(counts[d]) * U64(0xD6E8FEB86659FD93)
        out[out_off[d]] = v
    return mix(out), out_off


def distinct(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and the new offsets."""
    parts = [np.unique(h[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class MinHash:
    """k minima of 32-bit multiplicative rehashes of already random 64-bit hashes."""

    def __init__(self, k: int, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        self.k = k
        self.mul = r.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.xor = r.integers(0, 2**32, k, dtype=np.uint32)

    def __call__(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, k); documents without hashes get the largest value everywhere."""
        n = len(off) - 1
        out = np.full((n, self.k), np.uint32(0xFFFFFFFF))
        full = np.flatnonzero(np.diff(off))
        if len(full) == 0:
            return out
        low, high = (h & U64(0xFFFFFFFF)).astype(np.uint32), (h >> U64(32)).astype(np.uint32)
        starts = off[:-1][full]
        for j in range(self.k):
            x = ((low if j % 2 else high) ^ self.xor[j]) * self.mul[j]
            x ^= x >> np.uint32(15)
            out[full, j] = np.minimum.reduceat(x * self.mul[(j + 1) % self.k], starts)
        return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each run of `rows` minima, different from band to band."""
    n, k = signature.shape
    count = k // rows
    s = signature[:, : count * rows].reshape(n, count, rows).astype(U64)
    key = np.broadcast_to(mix(np.arange(1, count + 1, dtype=U64)), (n, count)).copy()
    for j in range(rows):
        key = mix(key ^ s[:, :, j] * _SHINGLE[j])
    return key


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as a binary value."""
    raw = np.ascontiguousarray(matrix)
    width = raw.shape[1] * raw.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())


def binary_segments(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each segment of an array as a binary value."""
    at = (off * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def matrix_of(col: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of binary_rows."""
    data, off = text_buffers(col.cast(pa.binary()))
    return data.view(dtype).reshape(len(off) - 1, width) if data.ctypes.data % np.dtype(dtype).itemsize == 0 else np.frombuffer(data.tobytes(), dtype).reshape(len(off) - 1, width)


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == U64 else a.astype(np.int64))


def list_of(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), longs(values))
