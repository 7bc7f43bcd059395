"""Vectorised words and word hashes over Arrow string arrays.

Words are the maximal runs ``[^\\x20\\x09-\\x0D]+`` of a text. Hashes are taken
over UTF-8 bytes with a polynomial modulo 2**64 whose prefix sums give the hash
of every word of a batch at once; a bijective mixer then spreads the bits.
Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word where punctuation does not belong to words.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PI = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that are hashed at once; a longer text is one chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        for k, base in enumerate((_P, _PI)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """Words of a run of texts: byte ranges in ``buf``, hashes, and for each text its range of words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool, apart: np.ndarray = _SPACE):
        self.raw, self.offs = buf, offs
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        space = apart[buf]
        begin = ~space
        end = begin.copy()
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        keep_b, keep_e = begin[inner], end[inner - 1]
        begin[1:] &= space[:-1]
        begin[inner] = keep_b
        end[:-1] &= space[1:]
        end[inner - 1] = keep_e
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offs)
        up, down = _tables(len(buf) + 1)
        pre = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=pre[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((pre[self.end] - pre[self.start]) * down[self.start] + size * _Q)

    def __len__(self) -> int:
        return len(self.offs) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]

    def word(self, j: int) -> bytes:
        return self.buf[self.start[j] : self.end[j]].tobytes()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(column, lower: bool = True, limit: int = CHUNK, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) over runs of whole texts of about ``limit`` bytes."""
    buf, offs = utf8(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower, apart)
        i = j


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries of ``h``, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    power, size, bit = h, 1, k
    scale = {1: _Q}
    while bit:
        if bit & 1:
            if out is None:
                out, have = power, size
            else:
                m = len(h) - have - size + 1
                out = out[:m] * scale[size] + power[have : have + m]
                have += size
        bit >>= 1
        if bit:
            m = len(power) - size
            power = power[:m] * scale[size] + power[size : size + m]
            scale[2 * size] = np.uint64(int(scale[size]) * int(scale[size]) & (2**64 - 1))
            size *= 2
    return mix(out)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i+1]]`` for each i, empty runs included."""
    total = np.r_[np.zeros(1, values.dtype), np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]
