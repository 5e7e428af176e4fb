"""Token ids in packed rows: best-fit-decreasing packing with a segment tree.

Each task tokenises its documents and packs them in batches of bounded size.  Pieces of
documents are placed by falling length, each into the fullest row that still takes it; a
segment tree over the free capacities finds that row in logarithmic time.  Documents
longer than a row are split without loss.  Nothing is shuffled, and a lost task is simply
run again.

Nulls and edge cases: null and empty texts have no ids and still get their end-of-text id
if one is set, else they are in no row; ties in length keep input order; an empty table
gives an empty result; repeated rows, and rows with null or shared doc_ids, are packed
each under a number of its own; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import map_arrow
from tessera.llm.spm import load

#: Ids that a task packs at a time; bounds its memory.
BATCH_TOKENS = 4_000_000


class CapacityTree:
    """Segment tree over free capacities 0..size that have a row."""

    def __init__(self, size: int):
        self.base = 1 << (size + 1).bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the smallest capacity >= ``least``."""
        i = self.base + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.base
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of item indices; every item is at most ``size`` long."""
    tree, rows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        tree.put(capacity - lengths[i], row)
    return rows


PACK_DDL = ("pack_id long, n_tokens int, ids binary, doc_ids array<long>, doc_numbers array<long>, parts array<int>, "
            "cu_seqlens array<int>, position_resets array<int>")
_LISTS = {"doc_ids": np.int64, "doc_numbers": np.int64, "parts": np.int32, "cu_seqlens": np.int32, "position_resets": np.int32}
#: Rows of one binary file: 32 MB of ids at 4,096 a row.
FILE_ROWS = 4096


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(out["pack_id"], pa.int64()), pa.array(out["n_tokens"], pa.int32()), pa.array(out["ids"], pa.binary()),
        *(pa.array(out[k], pa.list_(pa.from_numpy_dtype(t))) for k, t in _LISTS.items())], names=["pack_id", "n_tokens", "ids", *_LISTS])


def pack_documents(docs: DataFrame, model_path: str, *, row_tokens: int = 4096, end_id: int | None = 2,
                   pad_id: int = 0, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Rows of ``row_tokens`` ids packed from whole texts.

    Returns pack_id, n_tokens (without padding), ids (little-endian 16-bit, padded to the
    row), doc_ids, doc_numbers and parts (which document, its number in this packing, and
    which part of it each segment holds), cu_seqlens (cumulative segment lengths from 0)
    and position_resets (where position ids start from 0 again).  A vocabulary of more
    than 65,536 pieces is refused.
    """
    pieces = len(load(model_path).model.pieces)
    if max(pieces - 1, pad_id, end_id or 0) > 0xFFFF:
        raise ValueError(f"ids of {pieces} pieces do not fit 16 bits")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        number = document = (context.partitionId() if context else 0) << 40
        encoder = load(model_path)
        end = np.array([end_id], "<u2").tobytes() if end_id is not None else b""
        pad = np.array([pad_id], "<u2").tobytes()
        held: list[tuple[int | None, int, int, bytes]] = []
        total = 0

        def flush():
            nonlocal number
            lengths = [len(x[-1]) // 2 for x in held]
            out = {k: [] for k in ("pack_id", "n_tokens", "ids", *_LISTS)}
            for row in best_fit_decreasing(lengths, row_tokens):
                sums = np.cumsum([0] + [lengths[i] for i in row]).tolist()
                out["pack_id"].append(number)
                out["n_tokens"].append(sums[-1])
                out["ids"].append(b"".join(held[i][3] for i in row) + pad * (row_tokens - sums[-1]))
                for k, name in enumerate(("doc_ids", "doc_numbers", "parts")):
                    out[name].append([held[i][k] for i in row])
                out["cu_seqlens"].append(sums)
                out["position_resets"].append(sums[:-1])
                number += 1
            return _batch(out)

        step = 2 * row_tokens
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for ch, flat, first in encoder.slices(b.column(1)):
                whole, bounds = flat.astype("<u2").tobytes(), (2 * first).tolist()
                for r in range(ch.rows):
                    ids = whole[bounds[r]:bounds[r + 1]] + end
                    for part, at in enumerate(range(0, len(ids), step)):
                        held.append((doc_ids[ch.lo + r], document, part, ids[at:at + step]))
                        total += len(held[-1][3]) // 2
                        if total >= batch_tokens:
                            yield flush()
                            held, total = [], 0
                    document += 1
        if held:
            yield flush()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PACK_DDL)


def unpack_rows(packed: DataFrame) -> DataFrame:
    """doc_number, doc_id and ids of every document again, its parts in order.

    Documents are told apart by their number in the packing, so null and repeated ids do
    not mix.
    """
    def run(batches):
        for b in batches:
            out = ([], [], [], [])
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2").astype(np.int32)
                for d, n, p, lo, hi in zip(row["doc_ids"], row["doc_numbers"], row["parts"], row["cu_seqlens"], row["cu_seqlens"][1:]):
                    for column, value in zip(out, (n, d, p, ids[lo:hi])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int32()))], names=["doc_number", "doc_id", "part", "ids"])

    pieces = map_arrow(packed.select("doc_ids", "doc_numbers", "parts", "cu_seqlens", "ids"), run, "doc_number long, doc_id long, part int, ids array<int>")
    # the parts of one document are as large as the document
    whole = pieces.groupBy("doc_number").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("p"))
    return whole.select("doc_number", "doc_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Write packed rows as numpy files that trainers map into memory; returns the manifest.

    ``folder`` is a path or URI that all executors reach through ``pyarrow.fs`` and Spark.
    Each file (``.npz``) has up to ``FILE_ROWS`` rows: ``ids`` (rows x tokens, 16-bit),
    ``pack_id``, ``n_tokens``, and for each list column its values end to end with
    ``<name>_at``, where each row's begin.  Null doc_ids are marked in ``doc_ids_null``.
    A file appears under its name once it is whole; the manifest in ``folder/manifest``
    names those of successful tasks, so what a lost task left behind is never read.
    """
    def run(batches):
        import io
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, rows, names, counts, tokens = [], 0, [], [], []
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)

        def flush():
            table = pa.Table.from_batches(held)
            ids = np.frombuffer(b"".join(table["ids"].to_pylist()), "<u2").reshape(table.num_rows, -1)
            arrays = {"ids": ids, "pack_id": table["pack_id"].to_numpy(), "n_tokens": table["n_tokens"].to_numpy()}
            for name, kind in _LISTS.items():
                column = table[name].combine_chunks()
                arrays[name] = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                arrays[name + "_at"] = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            arrays["doc_ids_null"] = table["doc_ids"].combine_chunks().flatten().is_null().to_numpy(zero_copy_only=False)
            data = io.BytesIO()
            np.savez(data, **arrays)
            name = f"packed-{part:06d}-{len(names):06d}-{uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{root}/.{name}") as f:
                f.write(data.getbuffer())
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            names.append(name)
            counts.append(table.num_rows)
            tokens.append(int(arrays["n_tokens"].sum()))

        for b in batches:
            for at in range(0, b.num_rows, FILE_ROWS):
                held.append(b.slice(at, FILE_ROWS))
                rows += held[-1].num_rows
                if rows >= FILE_ROWS:
                    flush()
                    held, rows = [], 0
        if held and rows:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(tokens, pa.int64())], names=["file", "rows", "tokens"])

    manifest = f"{folder.rstrip('/')}/manifest"
    map_arrow(packed.select("pack_id", "n_tokens", "ids", *_LISTS), run, "file string, rows long, tokens long").write.parquet(manifest)
    return packed.sparkSession.read.parquet(manifest)


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    """The packed rows that ``write_binary`` wrote."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    a = np.load(f)
                    a = {k: a[k] for k in a.files}
                out = {"pack_id": a["pack_id"], "n_tokens": a["n_tokens"], "ids": [x.tobytes() for x in a["ids"]]}
                for k in _LISTS:
                    values = [None if n else v for v, n in zip(a[k].tolist(), a["doc_ids_null"])] if k == "doc_ids" else a[k].tolist()
                    at = a[k + "_at"].tolist()
                    out[k] = [values[x:y] for x, y in zip(at, at[1:])]
                yield _batch(out)

    return map_arrow(spark.read.parquet(f"{folder.rstrip('/')}/manifest").select("file"), run, PACK_DDL)
