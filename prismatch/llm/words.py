"""Words of whole Arrow text columns as flat numpy arrays.

A column becomes one byte buffer; words are (start, end) places in it and every
word has a 64-bit hash. Nothing is done per row in Python, and callers cut a
batch into slices of a few megabytes so that memory stays bounded however many
long texts meet in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: word bytes of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEPARATORS = {"space": _SPACE, "alnum": _NOT_ALNUM}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
ROLL = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _P2
    h = (h ^ (h >> np.uint64(27))) * _P3
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``buf`` has 8 spare bytes at its end; word ``i`` of row ``r`` lies in ``first[r] <= i < first[r + 1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes (a longer text makes a range of its own)."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    lo, n = 0, len(size)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def text_bytes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (null: none) with 8 spare bytes, and the rows' offsets."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.zeros(int(at[-1] - at[0]) + 8, np.uint8)
    if at[-1] > at[0]:
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        out[:-8] = _LOWER[raw] if lower else raw
    return out, at - at[0]


def split(buf: np.ndarray, offsets: np.ndarray, separators: str) -> Words:
    n = len(buf) - 8
    word = np.zeros(n + 2, bool)  # a separator before and behind
    np.logical_not(SEPARATORS[separators][buf[:n]], out=word[1:-1])
    begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = word[1:-1][inner]
    end[inner - 1] = word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def words_of(column: pa.Array, separators: str = "space", lower: bool = True) -> Words:
    return split(*text_bytes(column, lower), separators)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time over all spans."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = ends - starts
    h = (size.astype(np.uint64) + np.uint64(1)) * _P1
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    rest, k = np.flatnonzero(size > 8), 8
    while len(rest):
        left = size[rest] - k
        h[rest] = mix(h[rest] * _P1 ^ (eight[starts[rest] + k] & _MASK[np.minimum(left, 8)]))
        rest, k = rest[left > 8], k + 8
    return h


def hash_words(w: Words) -> np.ndarray:
    return hash_spans(w.buf, w.starts, w.ends)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on (``len(h) - k + 1`` values, across row ends too)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, part, size, left = None, 0, h, 1, k
    while left:  # binary digits of k: part covers ``size`` words from each place
        if left & 1:
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - done)
                out = out[:m] * power_of(size) + part[done : done + m]
            done += size
        left >>= 1
        if left:
            part = part[:-size] * power_of(size) + part[size:]
            size *= 2
    return mix(out[: len(h) - k + 1])


def power_of(n: int) -> np.uint64:
    return np.uint64(pow(int(ROLL), n, 1 << 64))


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``k`` words of one row begin, and the row of each."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), rows


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def joined_rows(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of every row, with single spaces between, and the rows' offsets."""
    starts, size = w.starts[kept], (w.ends - w.starts)[kept]
    first = np.concatenate([[0], np.cumsum(kept)])[w.first]
    n = np.diff(first)
    spaces = np.ones(len(size), np.int64)  # one before every word but the first of a row
    spaces[first[:-1][n > 0]] = 0
    begin = np.cumsum(size + spaces) - size
    total = int((size + spaces).sum())
    out = np.full(total, 0x20, np.uint8)
    before = np.cumsum(size) - size
    flat = np.arange(int(size.sum()))
    out[flat + np.repeat(begin - before, size)] = w.buf[flat + np.repeat(starts - before, size)]
    return out, np.concatenate([[0], np.cumsum(size + spaces)])[first]
