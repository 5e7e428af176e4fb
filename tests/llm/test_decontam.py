"""Latent retrieval against exact algebra and all-pairs comparison."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import decontam
from tessera.llm.bytesops import chunks

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def matrix(column, q):
    """Rows of A, built word by word."""
    rows = []
    known = {int(t): i for i, t in enumerate(q.terms)}
    for text in decontam._folded(column).to_pylist():
        words = text.split()
        starts = list(range(0, max(1, len(words) - decontam.PASSAGE + 1), decontam.STRIDE))
        if words and starts[-1] + decontam.PASSAGE < len(words):
            starts.append(len(words) - decontam.PASSAGE)
        for s in starts if words else []:
            part = words[s:s + decontam.PASSAGE]
            h = next(chunks(pa.array([" ".join(part)]))).word_hash()
            w = q.idf[h >> np.uint64(64 - decontam.COUNT_BITS)].astype(float)
            row = np.zeros(len(q.terms))
            for x, v in zip(h, w):
                if int(x) in known:
                    row[known[int(x)]] += v
            if row.any():
                rows.append(row / np.sqrt((w * w).sum()))
    return np.array(rows)


def small_block():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = pa.array([text(n) for n in (1, 5, 16, 17, 24, 40, 133, 300)] + [None, ""])
    q = decontam.make_queries([(i, " ".join(rng.sample(words[:60], 20)), None) for i in range(4)], np.arange(1 << decontam.COUNT_BITS) % 90)
    return docs, q


def test_sketch_is_the_product():
    docs, q = small_block()
    a = matrix(docs, q)
    for width in (7, 40):
        sketch = decontam.Sketch.of(len(q.terms), width, 1)
        got = np.zeros((len(q.terms), width))
        for ch in chunks(decontam._folded(docs)):
            decontam.Passages(ch, q, decontam.STRIDE).add_sketch(sketch, got)
        assert np.allclose(got, a.T @ a @ sketch.dense(), atol=1e-5)


def test_truncated_basis_is_an_svd():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 90))  # of rank 20
    sketch = decontam.Sketch.of(90, 60, 5)
    v, s = decontam.truncated_basis(a.T @ a @ sketch.dense(), sketch, 12)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s, want[:12], rtol=1e-3)
    assert np.allclose(np.abs(np.einsum("ij,ji->i", vt[:12], v)), 1, atol=1e-3)
    assert np.allclose(v.T @ v, np.eye(12), atol=1e-8)


def test_latent_rows_are_unit_projections():
    docs, q = small_block()
    a = matrix(docs, q)
    basis = np.linalg.qr(np.random.default_rng(3).normal(size=(len(q.terms), 9)))[0]
    table = (basis * q.idf[q.terms >> np.uint64(64 - decontam.COUNT_BITS)][:, None]).astype(np.float32)
    got = np.vstack([decontam.Passages(ch, q, decontam.STRIDE).latent(table, slice(None)) for ch in chunks(decontam._folded(docs))])
    want = a @ basis
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-4)


def true_pairs(rows, items, every=4):
    """All pairs by the LCS and answer rules alone, over every stretch of every document."""
    out = set()
    for item, text in items:
        words = decontam._words(text)
        masks, answer, size = decontam.bit_masks(words), decontam._answer_words(text, None), len(words)
        for d, t in rows:
            own = decontam._words(t or "")
            for at in range(0, max(1, len(own)), every):
                region = own[max(0, at - size):at + decontam.PASSAGE + size]
                if sum(w in masks for w in region) < 0.5 * size:
                    continue
                ratio = decontam.common_subsequence(words, region, masks) / size
                if ratio >= 0.6 or ratio >= 0.5 and len(answer.intersection(region)) >= 0.6 * len(answer):
                    out.add((d, item))
                    break
    return out


def test_recall_against_all_pairs(spark):
    """The given tables, with paraphrases whose every 3rd, 4th or 5th word is new."""
    rng = random.Random(9)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    hosts = [t.split() for _, t in rows if 30 <= len(t.split()) <= 300]
    for k in (3, 4, 5):
        for n, (_, text) in enumerate(items):
            w = [f"zq{rng.randrange(1 << 24):06x}" if j % k == k - 1 else x for j, x in enumerate(text.split())]
            host = hosts[(n + k) % len(hosts)]
            at = rng.randrange(len(host))
            rows.append((10_000 * k + n, " ".join([*host[:at], *w, *host[at:]])))
    want = true_pairs(rows, items)
    found = decontam.find_leaks(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(want) >= 3 * len(items) and len(want & got) >= 0.95 * len(want)
    # what is found beyond them is near the bound: regions grow where passages overlap
    for d, i in got - want:
        words = decontam._words(dict(items)[i])
        assert decontam.common_subsequence(words, decontam._words(dict(rows)[d])) >= 0.5 * len(words)


def test_clashing_columns_repeats_and_long_texts(spark):
    item = " ".join(f"b{i}" for i in range(20))
    long = " ".join(f"x{i % 997}" for i in range(60_000))
    rows = [(1, item, "a"), (1, item, "a"), (2, long, "b"), (3, f"{long} {item} {long}", "c"), (None, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", leaked string").withColumnRenamed("leaked", "item_id")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1)], "item_id long, text string, doc_id int")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()) == [(1, 7)] * 4 + [(3, 7)] * 2
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
