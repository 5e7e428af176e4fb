"""Character n-grams of the toxicity classifier, and its held-out figures on the larger table."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import bytesops, toxicity


def bucket(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) + 1) & 0xFFFFFFFF
    g = h ^ (h >> 15)
    g = (g * 0x2C1B3C6D + len(gram)) & 0xFFFFFFFF
    return ((g ^ (g >> 12)) * 0x297A2D39 & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def plain(text):
    low = "".join(" " if c.isspace() else c.lower() if ord(c) < 0x2000 and len(c.lower()) == 1 else c for c in text or "")
    padded = f" {low} "
    return sorted({bucket(padded[i:i + n]) for n in toxicity.GRAMS for i in range(len(padded) - n + 1)})


def test_grams_are_characters():
    rng = random.Random(3)
    rows = ["", None, "a", "IDIOT", "идиот ИДИОТ", "日本語の文字", "😀 smile 😀", "ÀÉÎ õ", "tab\tline\nend", "x" * 300]
    rows += ["".join(rng.choice("aBé ж日😀\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    got = [b.tolist() for b in toxicity._row_buckets(pa.array(rows))]
    assert got == [plain(r) for r in rows]


def test_code_points():
    text = "aé日😀߿ࠀ￿\U00010000\U0010ffff z"
    buf = np.frombuffer(text.encode(), np.uint8)
    codes, before = bytesops.code_points(buf)
    assert codes.tolist() == [ord(c) for c in text] and before[-1] == len(text)
    # bytes that are no characters still count, one for each that begins one
    codes, before = bytesops.code_points(np.frombuffer(b"a\xff\xc3b\xe6", np.uint8))
    assert len(codes) == before[-1] == 5


def test_held_out_figures(spark):
    """About one toxic label in eight has no sign in its text that other texts share."""
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = toxicity.score_toxicity(spark.read.parquet(f"{data}/documents.parquet"), labels)
    rows = scored.join(labels, "doc_id").filter("held_out and toxic is not null").select("toxic", "predicted").collect()
    hit = sum(r["toxic"] == 1 == r["predicted"] for r in rows)
    assert hit >= 0.75 * sum(r["toxic"] == 1 for r in rows) and hit >= 0.95 * sum(r["predicted"] == 1 for r in rows)
