"""Bloom filters of 64-bit hashes, small enough to broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_arrow, tree_fold

_PROBES = 4
#: Rows whose filter may be broadcast: about 10 bits each, 32 MB at most.
FILTER_ROWS = 1 << 24


def _bits(h: np.ndarray, size: int):
    """Bit numbers of hashes in a filter of ``size`` bytes, a power of two."""
    step = (h >> np.uint64(33)) | np.uint64(1)
    for k in range(_PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(8 * size - 1)).astype(np.int64)


def bloom_filter(column: DataFrame, rows: int) -> np.ndarray:
    """Filter of a column of hashes (long, no nulls), put together in a tree on the executors.

    ``rows`` is their number, at most ``FILTER_ROWS``.
    """
    size = 1 << max(10, (10 * rows // 8).bit_length())

    def fill(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for at in _bits(b.column(0).to_numpy().view(np.uint64), size):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    # a bounded number of rows: a few tasks fill few large filters
    found = tree_fold(map_arrow(column.coalesce(6), fill, "bits binary"), np.uint8, np.bitwise_or)
    return np.zeros(size, np.uint8) if found is None else found


def in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Flags of the hashes that the filter may hold; few others, none of them missing."""
    live = np.arange(len(h))
    for at in _bits(h, len(bits)):
        at = at[live]
        live = live[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[live] = True
    return out
