"""Vector code compression: product codes from integer codebooks, by Yinyang Lloyd rounds.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook that Lloyd rounds improve.  Codebook entries are clustered into a few groups.
For every part of a vector a row keeps one lower bound a group: no entry of the group, but
for the assigned one, is nearer.  After an update the bound shrinks by the farthest move in
the group, and only groups whose bound no longer exceeds the distance to the assigned entry
are scanned.  Bounds and moves are whole numbers, rounded down and up, and squares are
compared in integers: a skipped group is strictly farther, so ties stay exact.

A round is one pass: each task assigns its vectors, writes their codes and bounds, and adds
one row with its sums by entry, of a size that does not depend on the data.  The codebooks
(parts x entries x width) are all that reaches the driver and every task.

Nulls and edge cases: vectors that are null, or hold null or non-finite components, go, and
so do those whose length is no multiple of the parts, or not that of the kept vector with
the least vec_id.  A null vec_id comes last; rows with equal vec_id and repeated rows give a
row each, ties among them for the first entries are broken by the vector.  Fewer vectors than entries
make shorter codebooks.  A null label is a label of its own.  An empty table gives an empty
result; extra columns don't matter.  Components of 65,536 and more are refused with an
error, as their squares would not stay exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import discard, map_arrow, materialise, tree_sum

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Groups of a codebook: about a tenth of its entries.
GROUPS = 6
LARGEST = 1 << 24
FAR = np.uint16(65535)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(SCALE * x) from an array column whose lists all have ``width`` values."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, width)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (int64) of all rows of ``x`` to all rows of ``c``."""
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * high * high * x.shape[1] < 1 << 52:  # all terms are whole numbers that doubles hold
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] - 2.0 * (fx @ fc.T) + (fc * fc).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for i, entry in enumerate(c):
        out[:, i] = ((x - entry) ** 2).sum(1)
    return out


def roots(squares: np.ndarray, *, up: bool = False) -> np.ndarray:
    """Square roots of whole numbers, rounded down, or up."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r + (r * r < squares) if up else r


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """Group of every codebook entry, by a few Lloyd rounds over the entries themselves."""
    k = min(groups, len(entries))
    centre = entries[np.linspace(0, len(entries) - 1, k).astype(int)].astype(np.float64)
    for _ in range(rounds):
        at = ((entries[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        for g in range(k):
            if (at == g).any():
                centre[g] = entries[at == g].mean(0)
    return at


class Book:
    """Codebooks of all parts, the groups of their entries, and the moves of the last update."""

    def __init__(self, entries: np.ndarray, group: np.ndarray | None = None, drift: np.ndarray | None = None):
        self.entries = entries  # parts x entries x width, int64
        self.group = np.stack([grouped(e) for e in entries]) if group is None else group
        self.drift = np.zeros((len(entries), GROUPS), np.int64) if drift is None else drift

    def updated(self, sums: np.ndarray, counts: np.ndarray) -> Book:
        """Entries at the floor of their parts' means; unused ones stay."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        moved = roots(((new - self.entries) ** 2).sum(2), up=True)
        drift = np.zeros((len(new), GROUPS), np.int64)
        for p in range(len(new)):
            np.maximum.at(drift[p], self.group[p], moved[p])
        return Book(new, self.group, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _least_two(d: np.ndarray, names: np.ndarray):
    """Least distance of each row, its entry (the lower on ties) and the least of the others."""
    at = d.argmin(1)  # entries ascend within a group, so the first is the lower one
    row = np.arange(len(d))
    first = d[row, at]
    if d.shape[1] == 1:
        return first, names[at], np.full(len(d), -1)
    d[row, at] = np.iinfo(np.int64).max
    return first, names[at], d.min(1)


def assign_part(x: np.ndarray, book: Book, part: int, code: np.ndarray | None = None, low: np.ndarray | None = None):
    """Nearest entries of the rows ``x`` of one part.

    Returns codes, squared distances, lower bounds (rows x groups) and the number of
    distances computed.  Without ``code`` and ``low``, those of the round before, every
    group is scanned.
    """
    entries, group = book.entries[part], book.group[part]
    n = len(x)
    bounds = np.full((n, GROUPS), FAR, np.int64)
    if code is None:
        old = None
        best, error = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        scan = np.ones((n, GROUPS), bool)
        computed = 0
    else:
        old = best = code.astype(np.int64)
        error = ((x - entries[best]) ** 2).sum(1)
        left = np.maximum(low.astype(np.int64) - book.drift[part], 0)
        bounds[:] = left
        scan = left * left <= error[:, None]
        computed = n
    start = error
    best = best.copy()
    error = error.copy()
    seen = []
    for g in range(GROUPS):
        names = np.flatnonzero(group == g)
        rows = np.flatnonzero(scan[:, g])
        if not len(names) or not len(rows):
            continue
        first, name, second = _least_two(distances(x[rows], entries[names]), names)
        computed += len(rows) * len(names)
        nearer = (first < error[rows]) | ((first == error[rows]) & (name < best[rows]))
        best[rows[nearer]], error[rows[nearer]] = name[nearer], first[nearer]
        seen.append((g, rows, first, name, second))
    for g, rows, first, name, second in seen:
        others = np.where(name == best[rows], second, first)
        bounds[rows, g] = np.where(others < 0, FAR, np.minimum(roots(np.maximum(others, 0)), FAR))
    if old is not None:  # an entry that was left counts among its group's others again
        left = np.flatnonzero(best != old)
        g = group[old[left]]
        bounds[left, g] = np.minimum(bounds[left, g], roots(start[left]))
    return best, error, np.minimum(bounds, FAR).astype(np.uint16), computed


def _assigned(x: np.ndarray, book: Book, codes: np.ndarray | None, low: np.ndarray | None):
    """Codes (rows x parts, bytes), errors and bounds (rows x parts x groups) of a block."""
    parts, _, width = book.entries.shape
    code, total = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    bounds = np.empty((len(x), parts, GROUPS), np.uint16)
    for p in range(parts):
        own = x[:, p * width:(p + 1) * width]
        code[:, p], error, bounds[:, p], _ = assign_part(own, book, p, None if codes is None else codes[:, p], None if low is None else low[:, p])
        total += error
    return code, total, bounds


def _binary(a: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    a = np.ascontiguousarray(a)
    width = a[0].nbytes if len(a) else 0
    offsets = pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(a), [None, offsets, pa.py_buffer(a.tobytes())])


def _array(column: pa.Array, dtype, shape: tuple) -> np.ndarray:
    """Rows of an array from binary values of equal length."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(dtype).reshape(len(column), *shape)


def _round(book: Book, *, first: bool, last: bool, kind, block: int = 4096):
    """One pass: codes and bounds, and the sums of the task, or codes and errors at the end."""
    parts, entries, width = book.entries.shape
    dim = parts * width

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)
        schema = None
        for batch in batches:
            schema = batch.schema
            for lo in range(0, batch.num_rows, block):
                b = batch.slice(lo, block)
                x = integers(b.column(2), dim) if first else _array(b.column(2), kind, (dim,)).astype(np.int64)
                if first and len(x) and np.abs(x).max() >= LARGEST:
                    raise ValueError(f"components of {LARGEST // SCALE} and more are not coded")
                code, error, bounds = _assigned(x, book, None if first else _array(b.column(3), np.uint8, (parts,)), None if first else _array(b.column(4), np.uint16, (parts, GROUPS)))
                if last:
                    digits = _binary(np.frombuffer(code.tobytes().hex().encode(), np.uint8).reshape(len(code), 2 * parts)).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digits, pa.array(error)], names=["vec_id", "label", "code", "error"])
                    continue
                for p in range(parts):
                    np.add.at(sums[p, :, width], code[:, p], 1)
                    for i in range(width):
                        sums[p, :, i] += np.bincount(code[:, p], weights=x[:, p * width + i], minlength=entries).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(x.astype(kind)), _binary(code), _binary(bounds), pa.nulls(len(x), pa.binary())],
                                                 names=["vec_id", "label", "v", "code", "low", "sums"])
        if not last and schema is not None:
            none = [pa.nulls(1, schema.field(i).type) for i in (0, 1)] + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.tobytes()], pa.binary())], names=["vec_id", "label", "v", "code", "low", "sums"])
    return run


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector kept.

    ``vectors`` has vec_id, embedding (an array of numbers) and label.
    """
    if entries > 256:
        raise ValueError("a code has one byte a part")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & finite)
    label = kept.schema["label"].dataType.simpleString()
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    head = kept.select("vec_id", F.size("embedding").alias("dim"), "embedding").orderBy(*order).limit(1).collect()
    if not head:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = head[0]["dim"]
    kept = kept.filter(F.size("embedding") == dim)
    start = kept.select("vec_id", "embedding").orderBy(*order).limit(entries).collect()  # one codebook
    seeds = np.floor(np.array([r["embedding"] for r in start], np.float64) * SCALE).astype(np.int64)
    largest = kept.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0]
    kind = np.int16 if SCALE * largest < 32_000 else np.int32
    book = Book(np.ascontiguousarray(seeds.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2)))
    state, wide = kept, f"vec_id long, label {label}, v binary, code binary, low binary, sums binary"
    for r in range(rounds):
        done = materialise(map_arrow(state, _round(book, first=r == 0, last=False, kind=kind), wide), "codes")
        sums = tree_sum(done.filter("sums is not null").select("sums"), np.int64).reshape(parts, len(seeds), -1)
        book = book.updated(sums[:, :, :-1], sums[:, :, -1])
        if r:
            discard(before)
        before, state = done, done.filter("sums is null")
    coded = materialise(map_arrow(state, _round(book, first=rounds == 0, last=True, kind=kind), f"vec_id long, label {label}, code string, error long"), "codes-final")
    if rounds:
        discard(before)
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def decode(code: str, book: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([book[p, i] for p, i in enumerate(bytes.fromhex(code))])
