"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of ``PASSAGE`` words, one every ``STRIDE`` words.  A
distributed randomised SVD of their TF-IDF matrix gives a latent space; passages near a
benchmark passage by cosine there become candidates, and the longest common subsequence
with the item, and the item's answer, decide.

* Inverse document frequencies come from hashed term counts over all documents.
* Columns of the matrix A are the terms of the benchmark: other terms cannot add to a dot
  product with an item.  Rows are the passages of all documents, the same ones that are
  searched, and those of the benchmark weighted to equal energy.  Passages without any
  benchmark term are zero; no other passage is passed over, as its direction in the latent
  space may be an item's however little of its norm the benchmark terms hold (a paraphrase
  in rare words).
* Randomised SVD in one pass: (A'A)W for a sparse random sign matrix W of twice the rank is
  summed over the executors in a tree; a small factorisation gives the singular values and
  the right singular vectors, cut at the rank (Nystrom form).
* The benchmark is a stated query set: it is taken in blocks of ``block_items``, each with
  its own basis, against all documents.

Nulls and edge cases: null and empty texts have no passages; null and word-less items
are skipped; items shorter than a passage are one passage; repeated items and documents
each give their rows; an empty table on either side gives an empty result; extra columns
don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import Chunk, chunks, raw, texts_of
from tessera.llm.common import map_arrow, materialise, tree_sum

PASSAGE = 16
STRIDE = 8
ITEM_STRIDE = 4
COUNT_BITS = 17
RANK = 192
#: Entries in each row of the sketch matrix; its width is twice the rank.
SIGNS = 1
#: Bytes of text whose products are added up in single precision.
FIT_BYTES = 1 << 24
#: Characters of the items in a block.
BLOCK_CHARS = 1 << 17
#: Blocks of the benchmark that are held against the documents before a result is written.
BLOCKS_A_PASS = 4

_LEAD = np.uint64(46)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: ASCII punctuation, dropped inside words so that copies match despite changed marks.
_DROP = np.zeros(256, bool)
_DROP[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True


def _folded(column) -> pa.Array:
    """A-Z lowered and ASCII punctuation as spaces, byte for byte."""
    column = texts_of(column)
    buf, off = raw(column)
    out = _FOLD[buf]
    out[_DROP[buf]] = 32
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(out))


def _words(text: str) -> list[bytes]:
    return _folded(pa.array([text]))[0].as_py().encode().split()


def common_subsequence(item: list[bytes], region: list[bytes], masks: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if masks is None:
        masks = bit_masks(item)
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def bit_masks(item: list[bytes]) -> dict[bytes, int]:
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def term_counts(docs: DataFrame) -> np.ndarray:
    """Hashed term counts over all texts; 2 ** COUNT_BITS counters."""
    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for ch in chunks(_folded(b.column(0))):
                total += np.bincount(ch.word_hash() >> np.uint64(64 - COUNT_BITS), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    total = tree_sum(map_arrow(docs.select("text"), count, "counts binary"), np.int64)
    return np.zeros(1 << COUNT_BITS, np.int64) if total is None else total


@dataclass
class Queries:
    """A block of benchmark items, as every task needs it."""

    ids: list[int]
    words: list[list[bytes]]
    answers: list[set[bytes]]
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # by count bucket
    table: np.ndarray | None = None  # term x rank: the basis, each term by its idf
    latent: np.ndarray | None = None  # rank x query passage, unit length
    owner: np.ndarray | None = None  # item of each query passage
    singular: np.ndarray | None = None  # singular values kept

    def __post_init__(self):
        # one term for each leading part of a hash; the few others are searched for
        part = (self.terms >> _LEAD).astype(np.int64)
        self.slot = np.zeros(1 << 18, np.int32)
        self.slot[part] = np.arange(len(part))
        self.crowded = np.bincount(part, minlength=1 << 18) > 1

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of hashes among the terms, and whether each is one."""
        part = (h >> _LEAD).astype(np.int64)
        at = self.slot[part]
        known = self.terms[at] == h
        left = np.flatnonzero(self.crowded[part] & ~known)
        if len(left):
            at[left] = np.minimum(np.searchsorted(self.terms, h[left]), len(self.terms) - 1)
            known[left] = self.terms[at[left]] == h[left]
        return at, known


def _answer_words(text: str, answer: str | None) -> set[bytes]:
    """Words of the answer; without one, of the item's last sentence."""
    if answer is None:
        parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
        answer = parts[-1] if parts else ""
    return set(_words(answer))


def make_queries(rows: list[tuple[int, str, str | None]], counts: np.ndarray) -> Queries | None:
    rows = [(i, t, a) for i, t, a in rows if t and _words(t)]
    if not rows:
        return None
    words = [_words(t) for _, t, _ in rows]
    flat = pa.array([w.decode("utf-8", "surrogateescape") for x in words for w in x])
    hashes = np.concatenate([c.word_hash() for c in chunks(flat)])
    idf = np.log((1 + counts.sum()) / (1.0 + counts)).astype(np.float32)
    return Queries([i for i, _, _ in rows], words, [_answer_words(t, a) for _, t, a in rows], np.unique(hashes), idf)


class Passages:
    """Passages of a chunk: their known words (terms of the block) and their norms."""

    def __init__(self, ch: Chunk, q: Queries, stride: int):
        h = ch.word_hash()
        w = q.idf[h >> np.uint64(64 - COUNT_BITS)]
        at, known = q.find(h)
        n = ch.n_words
        # passages begin every ``stride`` words; the last one of a row ends with the row
        count = np.where(n == 0, 0, np.maximum(0, -(-(n - PASSAGE) // stride)) + 1)
        row = np.repeat(np.arange(ch.rows), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = ch.first[:-1][row] + np.minimum(step * stride, np.maximum(0, n[row] - PASSAGE))
        end = np.minimum(begin + PASSAGE, ch.first[1:][row])
        norm = np.concatenate(([0], np.cumsum(w * w, dtype=np.float64)))
        place = np.concatenate(([0], np.cumsum(known)))
        self.term, self.weight = at[known], w[known]
        # a passage without any known word is zero in the space and near to nothing
        keep = place[end] > place[begin]
        self.row, self.begin, self.end = row[keep], begin[keep], end[keep]
        self.lo, self.hi = place[self.begin], place[self.end]
        self.norm = np.sqrt(norm[self.end] - norm[self.begin])

    def __len__(self) -> int:
        return len(self.row)

    def latent(self, table: np.ndarray, part: slice) -> np.ndarray:
        """Unit vectors of the passages of ``part``: sums of their words' rows of ``table``."""
        lo, size = self.lo[part], (self.hi - self.lo)[part]
        # by falling size, so that those with a k-th word come first
        order = np.argsort(-size, kind="stable")
        lo, size = lo[order], size[order]
        z = table[self.term[lo]]
        for k in range(1, int(size[0]) if len(size) else 0):
            m = np.searchsorted(-size, -k)
            z[:m] += table[self.term[lo[:m] + k]]
        z /= np.maximum(1e-9, np.sqrt(np.einsum("ij,ij->i", z, z)))[:, None]
        out = np.empty_like(z)
        out[order] = z
        return out

    def add_sketch(self, sketch: "Sketch", into: np.ndarray) -> None:
        """Add A'A times the sketch matrix to ``into``, A being unit rows of these passages.

        Passages stand in order, so those that hold known words e and e + lag are the ones
        from the first that ends after e + lag to the last that begins by e; a prefix sum
        gives the sum of their 1 / norm^2.
        """
        n = len(self.term)
        if not len(self):
            return
        total = np.concatenate(([0.0], np.cumsum(1.0 / np.maximum(1e-18, self.norm * self.norm))))
        began = np.searchsorted(self.lo, np.arange(n), "right")
        ended = np.searchsorted(self.hi, np.arange(n), "right")
        flat, width = into.reshape(-1), into.shape[1]
        for lag in range(min(PASSAGE, n)):
            e = np.flatnonzero(began[:n - lag] > ended[lag:])
            f = e + lag
            value = (total[began[e]] - total[ended[f]]) * self.weight[e] * self.weight[f]
            for x, y in ((e, f), (f, e))[:1 + (lag > 0)]:
                row, other = self.term[x] * width, self.term[y]
                for column, sign in zip(sketch.column, sketch.sign):
                    np.add.at(flat, row + column[other], (value * sign[other]).astype(flat.dtype))


_BLOCK = 512


@dataclass
class Sketch:
    """Sparse random matrix, terms x width: ``SIGNS`` entries of -1 or 1 in each row."""

    column: np.ndarray
    sign: np.ndarray
    width: int

    @classmethod
    def of(cls, terms: int, width: int, seed: int) -> "Sketch":
        rng = np.random.default_rng(seed)
        return cls(rng.integers(0, width, (SIGNS, terms)), rng.choice([-1.0, 1.0], (SIGNS, terms)), width)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.column.shape[1], self.width))
        for column, sign in zip(self.column, self.sign):
            np.add.at(out, (np.arange(len(column)), column), sign)
        return out


def truncated_basis(y: np.ndarray, sketch: Sketch, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and singular values of A from y = A'A times the sketch.

    The Nystrom form of the randomised SVD: with the sketch W, A'A is y (W'y)^-1 y' on the
    range of y; a Cholesky factor of W'y and an SVD of the thin quotient give the largest
    ``rank`` singular pairs.
    """
    w = sketch.dense()
    shift = 1e-7 * float(np.linalg.norm(y)) + 1e-30
    y = y + shift * w
    core = w.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    live = values > 1e-9 * max(1e-30, float(values[-1]))
    u, s, _ = np.linalg.svd(y @ (vectors[:, live] / np.sqrt(values[live])), full_matrices=False)
    return u[:, :rank], np.sqrt(np.maximum(0.0, s[:rank] ** 2 - shift))


def _item_passages(q: Queries) -> list[Passages]:
    text = pa.array([b" ".join(w).decode("utf-8", "surrogateescape") for w in q.words])
    return [Passages(ch, q, ITEM_STRIDE) for ch in chunks(text, 1 << 30)]


def fit_basis(docs: DataFrame, q: Queries, *, rank: int = RANK, seed: int = 3) -> None:
    """Latent space of a block: randomised SVD of the passages of all documents."""
    terms = len(q.terms)
    sketch = Sketch.of(terms, min(2 * rank, terms), seed)
    sent = docs.sparkSession.sparkContext.broadcast((q, sketch))

    def product(batches):
        query, own = sent.value
        # a small table takes the sums of some text at a time, so that it stays in cache
        part, total, size = np.zeros((len(query.terms), own.width), np.float32), np.zeros((len(query.terms), own.width)), 0
        for b in batches:
            for ch in chunks(_folded(b.column(0))):
                Passages(ch, query, STRIDE).add_sketch(own, part)
                size += len(ch.buf)
                if size >= FIT_BYTES:
                    total += part
                    part[:], size = 0, 0
        total += part
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["g"])

    found = tree_sum(map_arrow(docs.select("text"), product, "g binary"), np.float32)
    corpus = np.zeros((terms, sketch.width)) if found is None else found.reshape(terms, sketch.width).astype(np.float64)
    own = np.zeros((terms, sketch.width))
    items = _item_passages(q)
    for p in items:
        p.add_sketch(sketch, own)
    # the benchmark has as much energy in the matrix as the corpus
    scale = max(1.0, float(np.linalg.norm(corpus)) / max(1e-9, float(np.linalg.norm(own))))
    basis, q.singular = truncated_basis(corpus + scale * own, sketch, rank)
    weight = q.idf[q.terms >> np.uint64(64 - COUNT_BITS)]
    q.table = (basis * weight[:, None]).astype(np.float32)
    q.owner = np.concatenate([p.row for p in items])
    q.latent = np.ascontiguousarray(np.vstack([p.latent(q.table, slice(None)) for p in items]).T)
    sent.unpersist()


def _candidates(ch: Chunk, q: Queries, cosine: float):
    """(row, item, first word, end word, cosine) of passages near an item's."""
    p = Passages(ch, q, STRIDE)
    width = q.latent.shape[1]
    for lo in range(0, len(p), _BLOCK):
        z = p.latent(q.table, slice(lo, lo + _BLOCK))
        sim = z @ q.latent
        near = np.flatnonzero(sim.max(1) >= cosine)
        if len(near):
            sim = sim[near].reshape(-1)
            hit = np.flatnonzero(sim >= cosine)
            r, c = lo + near[hit // width], hit % width
            yield p.row[r], q.owner[c], p.begin[r], p.end[r], sim[hit]


def _verified(region: list[bytes], q: Queries, item: int, masks):
    """LCS ratio with the item, and share of its answer words, in a region."""
    ratio = common_subsequence(q.words[item], region, masks) / len(q.words[item])
    answer = q.answers[item]
    return ratio, (len(answer.intersection(region)) / len(answer) if answer else 0.0)


LEAK_DDL = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, leaked boolean"


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, block_items: int = 256, cosine: float = 0.68,
               rank: int = RANK, sure: float = 0.6, likely: float = 0.5, answer_share: float = 0.6, keep_all: bool = False) -> DataFrame:
    """Pairs doc_id, item_id whose document holds the item or a paraphrase of it.

    A candidate is a leak if its longest common subsequence spans at least ``sure`` of
    the item's words, or at least ``likely`` of them with ``answer_share`` of the words of
    the answer (column ``answer`` of the benchmark if there is one, else the item's last
    sentence) close by.  Each region of a document is judged by itself; the ratios are
    those of the best one, a leak before others.  ``keep_all`` also returns the candidates
    that are not.
    """
    result = docs.sparkSession.createDataFrame([], LEAK_DDL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = cosine, sure, likely, answer_share
    for k, sent in enumerate(_fitted_blocks(docs, benchmark, block_items, rank)):
        found = map_arrow(docs, _search(sent, rules, keep_all), LEAK_DDL)
        result = found if k == 0 else result.unionByName(found)
        if k % BLOCKS_A_PASS == BLOCKS_A_PASS - 1:
            # the plan does not grow with the benchmark
            result = materialise(result, "leaks")
    return result


def _fitted_blocks(docs: DataFrame, benchmark: DataFrame, block_items: int, rank: int):
    """The benchmark's blocks, each broadcast with its basis."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer")).filter("text is not null")
    size = items.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"]:
        return
    counts = term_counts(docs)
    blocks = max(-(-size["n"] // block_items), -(-size["chars"] // BLOCK_CHARS))
    for block in range(blocks):
        # one block of a stated query set, about ``block_items`` rows
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        q = make_queries([(r["item_id"], r["text"], r["answer"]) for r in got], counts)
        if q is None:
            continue
        fit_basis(docs, q, rank=rank)
        yield docs.sparkSession.sparkContext.broadcast(q)


def _judged(column, q: Queries, masks: list[dict[bytes, int]], rules, keep_all: bool):
    """(row, item, cosine, LCS ratio, answer ratio, leaked) of the candidates of a text column.

    Without ``keep_all`` regions that cannot reach the least ratio are passed over.
    """
    cosine, sure, likely, answer_share = rules
    least = min(sure, likely)
    held = [{w: m.bit_count() for w, m in x.items()} for x in masks]
    for ch in chunks(_folded(column)):
        spots: dict[tuple[int, int], list] = {}
        for found in _candidates(ch, q, cosine):
            for r, item, lo, hi, sim in zip(*(x.tolist() for x in found)):
                spots.setdefault((r, item), []).append((lo - int(ch.first[r]), hi - int(ch.first[r]), sim))
        text = ch.buf.tobytes() if spots else b""
        last, words = -1, []
        for (r, item), places in sorted(spots.items()):
            if r != last:
                last, words = r, text[ch.off[r]:ch.off[r + 1]].split()
            best = (False, 0.0, 0.0)
            sim = max(s for _, _, s in places)
            # overlapping places are one region
            places.sort()
            lo, hi = places[0][:2]
            size = len(q.words[item])
            for x, y, _ in [*places[1:], (1 << 62, 0, 0)]:
                if x <= hi and y - lo <= 2 * size + PASSAGE:
                    hi = max(hi, y)
                    continue
                region = words[max(0, lo - size):hi + size]
                # the subsequence has no more words than the item has places of the region's words
                if keep_all or sum(map(held[item].__getitem__, held[item].keys() & region)) >= least * size:
                    ratio, share = _verified(region, q, item, masks[item])
                    best = max(best, (ratio >= sure or ratio >= likely and share >= answer_share, ratio, share))
                lo, hi = x, y
            leaked, ratio, share = best
            yield ch.lo + r, item, sim, ratio, share, leaked


def _search(sent, rules, keep_all):
    def run(batches):
        q = sent.value
        masks = [bit_masks(w) for w in q.words]
        for b in batches:
            ids = b.column(0)
            out = ([], [], [], [], [], [])
            for r, item, *found in _judged(b.column(1), q, masks, rules, keep_all):
                if found[-1] or keep_all:
                    for column, value in zip(out, (ids[r].as_py(), q.ids[item], *found)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.float64()) for x in out[2:5]), pa.array(out[5], pa.bool_())], names=["doc_id", "item_id", "cosine", "lcs_ratio", "answer_ratio", "leaked"])
    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, block_items: int = 256, cosine: float = 0.68, rank: int = RANK,
               sure: float = 0.6, likely: float = 0.5, answer_share: float = 0.6) -> DataFrame:
    """The rows that hold no benchmark item, as ``find_leaks`` judges them.

    Each row is judged by its own text where it is read, so no text is shuffled; its
    doc_id, null or shared, doesn't matter.
    """
    at = docs.columns.index("text")
    rules = cosine, sure, likely, answer_share

    def clean(sent):
        def run(batches):
            q = sent.value
            masks = [bit_masks(w) for w in q.words]
            for b in batches:
                ok = np.ones(b.num_rows, bool)
                ok[[r for r, *_, leaked in _judged(b.column(at), q, masks, rules, False) if leaked]] = False
                yield b.filter(pa.array(ok))
        return run

    kept = docs
    for k, sent in enumerate(_fitted_blocks(docs, benchmark, block_items, rank)):
        if k and k % BLOCKS_A_PASS == 0:
            # as many blocks as one task's workers hold at a time
            kept = materialise(kept, "leaks")
        kept = map_arrow(kept, clean(sent), docs.schema)
    return kept
