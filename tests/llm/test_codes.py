"""Vector codes against plain integer Lloyd rounds, and bounds against full scans."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import codes, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) by the definition."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and None not in v and all(math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book[p]))

    for _ in range(rounds):
        took = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for j in range(len(book[p])):
                own = [c[p] for c, t in zip(cut, took) if t[p] == j]
                if own:
                    book[p][j] = tuple(sum(x[d] for x in own) // len(own) for d in range(width))
    out, by_label = [], {}
    for (i, _, lab), c in zip(kept, cut):
        near = [nearest(c[p], p) for p in range(parts)]
        error = sum(d for d, _ in near)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in near), error, lab))
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, by_label[lab], digest) for i, c, e, lab in out]


def made(n, width, seed, coarse=False):
    rng = random.Random(seed)
    value = (lambda: rng.randrange(-3, 4) / 128) if coarse else (lambda: rng.gauss(0, 1))
    rows = [(i, [value() for _ in range(width)], rng.choice([None, 1, 1, 2])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,coarse", [(400, False), (400, True), (30, True), (1, False)])
def test_equals_plain_rounds(spark, n, coarse):
    rows = made(n, 32, n, coarse)
    rows += [(7, None, 1), (8, [], 1), (9, [0.5] * 31 + [None], 1), (10, [float("nan")] * 32, 2), (11, [float("inf")] * 32, None), (12, [1e4] * 32, 5), (None, [0.25] * 32, 5)]
    rows += rows[:2]
    got = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_other_lengths_go_and_large_ones_are_refused(spark):
    rows = made(80, 32, 3)
    odd = [(1000, [0.5] * 16, 1), (1001, [0.5] * 33, 1)]
    assert codes.compress(spark.createDataFrame(rows + odd, VECTORS)).count() == 80
    with pytest.raises(Exception, match="65536"):
        codes.compress(spark.createDataFrame(rows + [(1, [1e9] * 32, 1)], VECTORS)).count()
    assert codes.compress(spark.createDataFrame(odd[:0], VECTORS)).count() == 0


def test_clashing_columns(spark):
    rows = [(*r, "x", "y") for r in made(20, 16, 5)]
    got = codes.compress(spark.createDataFrame(rows, VECTORS + ", code string, _label string"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 20


def test_bounds_skip_groups_and_change_nothing():
    rng = np.random.default_rng(4)
    # vectors around few centres, which part codebooks settle on
    x = np.floor(rng.normal(0, 300, (20, 4))[rng.integers(0, 20, 3000)] + rng.normal(0, 20, (3000, 4))).astype(np.int64)
    book = codes.Book(x[None, :64].copy())
    code = low = None
    work = []
    for _ in range(5):
        code, error, low, computed = codes.assign_part(x, book, 0, code, low)
        full = ((x[:, None] - book.entries[0][None]) ** 2).sum(2)
        assert (code == full.argmin(1)).all() and (error == full.min(1)).all()
        # each bound holds for all entries of its group but the assigned one
        full[np.arange(len(x)), code] = np.iinfo(np.int64).max
        for g in range(codes.GROUPS):
            own = full[:, book.group[0] == g]
            if own.shape[1]:
                assert (low[:, g].astype(np.int64) ** 2 <= own.min(1)).all()
        work.append(computed)
        sums = np.zeros((1, 64, 4), np.int64)
        np.add.at(sums[0], code, x)
        book = book.updated(sums, np.bincount(code, minlength=64)[None])
    assert work[0] == 3000 * 64 and max(work[1:]) < 0.5 * work[0]


def test_decode_is_within_the_error(spark):
    rows = made(100, 32, 9)
    ints = {i: np.floor(np.float32(v).astype(float) * 256).astype(np.int64) for i, v, _ in rows}
    seeds = np.stack([ints[i] for i in sorted(ints)[:64]]).reshape(64, 16, 2).transpose(1, 0, 2)
    for r in codes.compress(spark.createDataFrame(rows, VECTORS), rounds=0).collect():
        assert ((codes.decode(r["code"], seeds) - ints[r["vec_id"]]) ** 2).sum() == r["error"]


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in queries.queries()["op11_vector_codes"](spark, folder).collect()]
    assert sorted(got) == sorted(plain(rows))
