"""Vectorised words, shingles and their 64-bit hashes over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole column at once. Word
patterns are given as byte classes, which is the same as the character classes
used by the operators because these treat all characters beyond ASCII alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of x."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 19)
            up = np.full(size, U64(_BASE), dtype=np.uint64)
            down = np.full(size, U64(_BASE_INV), dtype=np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null is like empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(col) + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and the first word of each row
    (with the number of words at the end). ``data`` holds rows back to back;
    words don't reach from one row into the next."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), zero, zero, np.zeros(len(offsets), dtype=np.int64)
    low = LOWER[data]
    inside = is_word[low]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _Powers.to(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * up, dtype=np.uint64, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    return mix(h), start, end, np.searchsorted(start, offsets)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, rows disregarded."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n] * _PLACE[0]
    for k in range(1, size):
        out += h[k : k + n] * _PLACE[k]
    out += U64(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words
    than ``size`` has its whole sequence as its one shingle, one without words
    has none."""
    h, _, _, first = words(data, offsets, is_word)
    w = windows(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(w[a : b - size + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(windows(h[a:b], b - a))
        else:
            out.append(w[:0])
    return out
