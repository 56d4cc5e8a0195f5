"""Words of Arrow string columns as NumPy arrays: byte positions and 64-bit hashes, without Python strings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Base of the polynomial word hash (odd, so powers have inverses modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[32, 9, 10, 11, 12, 13]] = True

#: ASCII other than digits and letters.
PUNCT_BYTES = np.zeros(256, dtype=bool)
PUNCT_BYTES[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT_BYTES[_a:_b] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POW: dict[str, np.ndarray] = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, grown as needed."""
    have = len(_POW["up"])
    if have < n:
        size = max(n, 1 << 18)
        for key, base in (("up", BASE), ("down", _INV)):
            p = np.full(size, U(base), dtype=U)
            p[0] = U(1)
            _POW[key] = np.multiply.accumulate(p)
    return _POW["up"][:n], _POW["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a run of documents. ``ptr[d]:ptr[d + 1]`` are document ``d``'s words."""

    data: np.ndarray     # bytes of all documents
    offsets: np.ndarray  # of documents in data
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # after its last byte
    ptr: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    if not len(column) or bufs[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(bufs[2], dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = 1 << 19):
    """(first, last) row ranges of at most ``limit`` bytes, or of a single longer document."""
    _, off = string_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE_BYTES,
                lower: bool = False) -> Words:
    """Maximal runs of bytes that are no separators, never across documents."""
    n = len(data)
    if lower:
        data = LOWER[data]
    ns = ~separators[data]
    left = np.zeros(n, dtype=bool)
    left[1:] = ns[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    left[inner] = False
    right = np.zeros(n, dtype=bool)
    right[:-1] = ns[1:]
    right[inner - 1] = False
    start = np.flatnonzero(ns & ~left)
    end = np.flatnonzero(ns & ~right) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), h)


def ngrams(words: Words, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; meaningless where fewer are left in its document."""
    h, out = words.hash, np.zeros(len(words.hash), dtype=U)
    for j in range(n):
        c = U((pow(BASE, 2 * j + 3, 1 << 64)) | 1)
        m = len(h) - j
        if m <= 0:
            break
        out[:m] += mix(h[j:] + U(j)) * c if j else h * c
    return mix(out)


def complete(words: Words, n: int) -> np.ndarray:
    """Whether ``n`` words of the same document start at each word."""
    left = np.repeat(words.ptr[1:], words.counts) - np.arange(len(words.hash))
    return left >= n
