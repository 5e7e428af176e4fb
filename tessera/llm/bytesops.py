"""Whole-batch text primitives on the UTF-8 bytes of an Arrow string column.

Words are the runs ``[^\\x20\\x09-\\x0D]+``.  All functions work on chunks of about
``CHUNK_BYTES`` so that temporary arrays stay small whatever the batch; a single longer
text makes its own chunk.  Hashes are 64-bit, so chance equality is about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)
WINDOW_BASE = np.uint64(0xD6E8FEB86659FD93)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[i] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and at each byte offset (the end too) how many begin before.

    Every byte that does not continue another begins one, also where bytes are not valid.
    """
    lead = (buf & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(lead)))
    at = np.flatnonzero(lead)
    padded = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.uint32)
    codes = padded[at]
    long = np.flatnonzero(codes >= 0xC0)
    if len(long):
        p, first = at[long], codes[long]
        tail = [padded[p + k] & 0x3F for k in (1, 2, 3)]
        codes[long] = np.where(first < 0xE0, (first & 0x1F) << 6 | tail[0], np.where(
            first < 0xF0, (first & 0x0F) << 12 | tail[0] << 6 | tail[1],
            (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
    return codes, before


def texts_of(column: pa.Array) -> pa.Array:
    """String column with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n + 1 offsets into them, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


@dataclass
class Chunk:
    """Rows ``lo:hi`` of a batch: bytes, row offsets, words and prefix hash sums."""

    lo: int
    hi: int
    buf: np.ndarray
    off: np.ndarray

    def __post_init__(self):
        buf, n = self.buf, len(self.buf)
        self.space = SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        solid = ~self.space
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = self.space[:-1]
            after[-1] = True
            after[:-1] = self.space[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, self.off)  # of each row's words; n + 1
        self._sums = None

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def word_row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.n_words)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans; equal spans hash alike wherever they stand."""
        power, inverse = _powers(len(self.buf) + 1)
        if self._sums is None:
            sums = np.empty(len(self.buf) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE_CODE[self.buf] * power[:len(self.buf)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def windows(self, word_hash: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word index and hash of every window of ``n`` words inside one row."""
        total = len(word_hash)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.first[1:], self.n_words)[:total - n + 1] - np.arange(total - n + 1)
        h = word_hash[:total - n + 1].copy()
        for k in range(1, n):
            h *= WINDOW_BASE
            h += word_hash[k:total - n + 1 + k]
        at = np.flatnonzero(left >= n)
        return at, mix(h[at])

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes of each row."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(sums[self.off])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty) into chunks of whole rows."""
    buf, off = raw(texts_of(column))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Chunk(lo, hi, buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Flags of the positions 0..n-1 that a window of ``width`` from ``starts`` covers."""
    d = np.zeros(n + width + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + width, -1)
    return np.cumsum(d)[:n] > 0


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs more than once, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    more = same.copy()
    more[:-1] |= same[1:]
    out_more, out_before = np.empty(len(k), bool), np.empty(len(k), bool)
    out_more[order], out_before[order] = more, same
    return out_more, out_before
