"""Grouped prefix join against all pairs; filters that lose nothing."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path[:0] = [str(Path(__file__).parent)]
import brute  # noqa: E402

from tessera.llm import queries, setjoin  # noqa: E402

DOCS = "doc_id long, text string"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = brute.WORD.findall(low)
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def plain(rows, percent=90):
    """(doc_id, n, component) of every row, by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= (percent / 10 - 0.001) * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def families(seed, n=40, size=12):
    """Texts in families of near copies about the bound, in words that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows, d = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 8, 11, 30, 60, 150]))]
        if rng.random() < 0.4:
            base[len(base) // 2:len(base) // 2] = shared
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w) + 1)
                w[at:at + 1] = rng.choice([[], [rng.choice(vocabulary)], [*w[at:at + 1], "x"]])
            rows.append((d, (" " if rng.random() < 0.5 else "\n").join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            d += 1
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"tile": 4}), (3, {"percent": 80}), (4, {"percent": 95, "tile": 7})])
def test_equals_all_pairs(spark, seed, options):
    rows = families(seed)
    got = result(setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4), **options))
    assert got == plain(rows, options.get("percent", 90))


def test_frequent_shingles_last(spark, monkeypatch):
    """Every shingle counts as frequent or not at random: any order gives the same rows."""
    rows = families(6)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(setjoin, "frequent_buckets", lambda docs, shingle: np.packbits(rng.random(setjoin.BUCKETS) < 0.5))
    assert result(setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3))) == plain(rows)


def test_nulls_copies_and_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a"), (None, "a b"), (None, "lonely words without an id"), (7, long), (8, long + " more"), (9, long), (9, "other text under one id"), (None, None)]
    rows += rows[:4] + [(20 + i, long.replace("v777 ", f"y{i} ")) for i in range(5)]
    got = result(setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5)))
    assert got == plain(rows)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, 2), (2, "a b c d", 3, 4)], DOCS + ", node int, key int")
    assert setjoin.jaccard_components(docs.limit(0)).count() == 0
    assert result(setjoin.jaccard_components(docs)) == [(1, 2, 1), (2, 2, 1)]


def test_a_crowd_costs_a_forest(spark):
    """A thousand near copies of one text: candidates grow with members, not with pairs."""
    rng = random.Random(8)
    base = [f"c{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    asked = []
    real = setjoin.verified
    try:
        setjoin.verified = lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1]
        got = setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    finally:
        setjoin.verified = real
    assert {r["component_id"] for r in got} == {0} and sum(asked) < 12 * len(rows)


def test_a_crowd_about_the_bound(spark):
    """Near copies of which most pairs are just below the bound: few pairs are verified, no link is lost."""
    rng = random.Random(9)
    base = [f"c{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(150)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    asked = []
    real = setjoin.verified
    try:
        setjoin.verified = lambda pairs, *rest: (asked.append(pairs.count()), real(pairs, *rest))[1]
        got = result(setjoin.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(4), tile=64))
    finally:
        setjoin.verified = real
    assert got == plain(rows) and sum(asked) < 0.25 * 260 * 259 / 2


def test_bitmaps_never_exceed_the_difference():
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.choice([3, 50, 130, 300, 700]))]
        for _ in range(3):
            sets.append({x for x in base if rng.random() < 0.97} | {rng.getrandbits(64) for _ in range(rng.randrange(9))})
    words = setjoin.map_words(np.array([len(s) for s in sets]), setjoin.NARROW)
    maps = []
    for s, w in zip(sets, words):
        bits = np.zeros(64 * int(w), np.uint8)
        for h in s:
            bits[h & (64 * int(w) - 1)] ^= 1
        maps.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
    kind = pa.list_(pa.int64())
    held = setjoin.Bitmaps(pa.array(maps, kind), pa.array([None] * len(sets), kind))
    a, b = np.triu_indices(len(sets), 1)
    apart = np.array([len(sets[i] ^ sets[j]) for i, j in zip(a, b)])
    assert held.at_most(a, b, apart).all()
    assert held.at_most(a, b, np.full(len(a), 12)).sum() < 0.3 * len(a)
    blind = setjoin.Bitmaps(pa.array(maps, kind), pa.array([[0] * len(m) for m in maps], kind))
    assert blind.at_most(a, b, np.zeros(len(a), int)).all()


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert result(queries.queries()["op12_jaccard_join"](spark, folder)) == plain(rows)
