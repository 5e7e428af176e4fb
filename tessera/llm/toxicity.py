"""Toxicity: character n-gram linear classifier with naive Bayes scaled features.

A text's features are the distinct character n-grams (lower case, white space as spaces, a
space before and after the text), hashed.  Each is scaled by its log-count ratio between
toxic and other training texts, and a logistic regression over the scaled features gives
the score.

The classifier is fitted on at most ``max_toxic`` + ``max_other`` labelled texts, chosen
by a hash of their ids; every document's whole text is scored.

Nulls and edge cases: a null text counts as empty and gets the score of the bias alone;
labels that are null or without a document are left out; of conflicting labels of one
doc_id the highest counts; without training texts of both kinds every score is the share
of toxic labels (0 without labels); an empty table gives an empty result; ties and
repeated rows score alike; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.bytesops import chunks, code_points
from tessera.llm.common import map_arrow, materialise, tree_sum

GRAMS = (4, 5, 7)
BITS = 21

_PRIME = np.uint32(0x01000193)
_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """By code point below 0x2000: its lower case, white space as a space."""
    if not _folds:
        table = np.arange(0x2000, dtype=np.uint32)
        for c in range(0x2000):
            low = chr(c).lower()
            if chr(c).isspace():
                table[c] = 32
            elif len(low) == 1:
                table[c] = ord(low)
        _folds.append(table)
    return _folds[0]


def _grams(ch):
    """For each n: hashed n-grams at every character of the rows, each row led by a space.

    Yields (n, bucket of each position), and first the padded rows' starts, with the end.
    """
    points, before = code_points(ch.buf)
    low = np.flatnonzero(points < 0x2000)
    points[low] = _fold()[points[low]]
    starts = before[ch.off] + np.arange(ch.rows + 1)
    codes = np.full(len(points) + ch.rows + 1, 32, np.uint32)
    at = np.ones(len(codes), bool)
    at[starts] = False
    codes[at] = points
    yield starts
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * _PRIME + codes[n - 1:n - 1 + m] + np.uint32(1)
        if n in GRAMS:
            g = h ^ (h >> np.uint32(15))
            g = g * np.uint32(0x2C1B3C6D) + np.uint32(n)
            yield n, (g ^ (g >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - BITS)


def _inside(starts: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the positions, and whether the n-gram stays in its row and its edge spaces."""
    row = np.searchsorted(starts, at, "right") - 1
    ok = row < len(starts) - 1
    row = np.minimum(row, len(starts) - 2)
    return row, ok & (at + n <= starts[row + 1] + 1)


def _row_buckets(column):
    """Each text's distinct buckets, sorted."""
    for ch in chunks(column):
        it = _grams(ch)
        starts = next(it)
        found = []
        for n, g in it:
            row, ok = _inside(starts, np.arange(len(g)), n)
            found.append((row[ok].astype(np.int64) << BITS) | g[ok])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cut = np.searchsorted(keys, np.arange(ch.rows + 1) << BITS)
        for x, y in zip(cut, cut[1:]):
            yield keys[x:y] & ((1 << BITS) - 1)


def _count_batches(batches):
    """Numbers of other and of toxic texts that have each bucket."""
    total = np.zeros((2, 1 << BITS), np.int32)
    for b in batches:
        for toxic, buckets in zip(b.column(0).to_pylist(), _row_buckets(b.column(1))):
            total[toxic, buckets] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


@dataclass
class ToxicModel:
    buckets: np.ndarray  # sorted buckets with a weight
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out


def choose_features(pos: np.ndarray, neg: np.ndarray, *, least_count: int = 10, least_ratio: float = 1.0, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose log-count ratio tells the kinds apart, and these ratios."""
    ratio = np.log(((pos + alpha) / (pos + alpha).sum()) / ((neg + alpha) / (neg + alpha).sum()))
    chosen = np.flatnonzero((pos + neg >= least_count) & (np.abs(ratio) >= least_ratio))
    return chosen, ratio[chosen]


def fit_columns(columns: list[np.ndarray], toxic: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, *, ridge: float = 2e-4, steps: int = 300) -> ToxicModel:
    """Logistic regression from each text's chosen features (places in ``chosen``)."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0 if share == 0 else 30.0)
    prior = float(np.log(share / (1 - share)))
    if not len(chosen):
        return ToxicModel(np.zeros(0, np.int64), np.zeros(0, np.float32), prior)
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    cols = np.concatenate(columns)
    scaled = ratio[cols]
    y = toxic.astype(float)
    # both kinds weigh as in the sample; momentum descent on the regularised log loss
    w, b = np.zeros(len(chosen)), prior
    vw, vb, n = np.zeros_like(w), 0.0, len(y)
    sw, sb = np.full_like(w, 1e-8), 1e-8
    for step in range(steps):
        z = b + np.bincount(owner, weights=scaled * w[cols], minlength=n)
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        gw = np.bincount(cols, weights=scaled * d[owner], minlength=len(w)) + ridge * w
        gb = d.sum()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        sw, sb = 0.99 * sw + 0.01 * gw * gw, 0.99 * sb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** (step + 1), 1 - 0.99 ** (step + 1)
        w -= 0.05 * (vw / c1) / (np.sqrt(sw / c2) + 1e-8)
        b -= 0.05 * (vb / c1) / (np.sqrt(sb / c2) + 1e-8)
    weights = w * ratio
    keep = np.abs(weights) > 0.02 * np.abs(weights).max()
    return ToxicModel(chosen[keep], weights[keep].astype(np.float32), b)


def learns(column="doc_id"):
    """Rows whose labels may be learned from: crc32 of the id as text is not 1 mod 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 != 1


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 2000, max_other: int = 4000, seed: int = 11) -> ToxicModel:
    """Fit on a bounded sample of labelled texts; see the module's text."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(learns())
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(max_toxic).union(known.filter("toxic = 0").orderBy(order, "doc_id").limit(max_other))
    # at most max_toxic + max_other ids are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    texts = materialise(texts, "toxicity-sample")
    counts = tree_sum(map_arrow(texts.coalesce(8), _count_batches, "counts binary"), np.int32)
    counts = (np.zeros(2 << BITS, np.int32) if counts is None else counts).reshape(2, -1)
    # few training texts have few texts for any feature
    chosen, ratio = choose_features(counts[1], counts[0], least_count=min(10, max(4, texts.filter("toxic = 1").count() // 30)))
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def columns(batches):
        place = np.full(1 << BITS, -1, np.int32)
        place[sent.value] = np.arange(len(sent.value))
        for b in batches:
            rows = [place[r] for r in _row_buckets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[r >= 0].tobytes() for r in rows], pa.binary())], names=["toxic", "places"])

    # a bounded number of rows, each with its chosen features only
    got = map_arrow(texts, columns, "toxic int, places binary").toPandas()
    return fit_columns([np.frombuffer(p, np.int32) for p in got["places"]], got["toxic"].to_numpy(int) == 1, chosen, ratio)


def score_column(column, table: np.ndarray, bias: float) -> np.ndarray:
    """Scores of a string column."""
    out = []
    for ch in chunks(column):
        it = _grams(ch)
        starts = next(it)
        found = []
        for n, g in it:
            at = np.flatnonzero(table[g])
            row, ok = _inside(starts, at, n)
            found.append((row[ok].astype(np.int64) << BITS) | g[at[ok]])
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        z = bias + np.bincount(keys >> BITS, weights=table[keys & ((1 << BITS) - 1)], minlength=ch.rows)
        out.append(1 / (1 + np.exp(-np.clip(z, -60, 60))))
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on)."""
    model = fit_toxicity(docs, labels, **fit)
    sent = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights, model.bias))

    def run(batches):
        buckets, weights, bias = sent.value
        table = ToxicModel(buckets, weights, bias).table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_column(b.column(1), table, bias))], names=["doc_id", "score"])

    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learns(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
