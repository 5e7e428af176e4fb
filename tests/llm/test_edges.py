"""Host graphs, rejected documents, many languages, repeated and missing ids, clashing names, SQL twins."""

import random
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]
import brute  # noqa: E402
from oracle import differences  # noqa: E402

from tessera.llm import common, langid, packing, quality, queries, simhash, substring, token_counts, url_filter  # noqa: E402

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name], DATA) is None


# ---- op4

PAGES = [
    (1, "http://good.org/a", '<a href="http://friend.net/x"> <img src=//cdn.net/i.png> <a HREF=\'http://friend.net/y\'>'),
    (2, "http://friend.net/x", '<a href="http://good.org/"> <a href="/local">'),
    (3, "http://bad.com/de/1", '<a href="http://prey.net/">'),
    (4, "http://lure.net/", '<a href="http://bad.com/de/2"> <a href="http://bad.com/de/2">'),
    (5, "http://prey.net/", None), (6, "http://alone.info/", "text"), (7, None, '<a href="http://good.org/">'), (8, "http://cdn.net/i", ""),
]


def ranks(edges, seeds, reverse, rounds=200):
    """Power iteration as written down."""
    if reverse:
        edges = {(b, a): w for (a, b), w in edges.items()}
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items() if w > 0}
    now = dict(start)
    for _ in range(rounds):
        new = {h: 0.15 * w for h, w in start.items()}
        for (a, b), w in edges.items():
            if a in now:
                new[b] = new.get(b, 0) + 0.85 * now[a] * w / out[a]
        now = new
    return now


def test_links_carry_trust_and_distrust(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    hosts = pages.select(url_filter.host_of(pages["url"]).alias("host"), "html")
    got = {(r["src"], r["dst"]): r["weight"] for r in url_filter.host_edges(hosts).collect()}
    links = {("good.org", "friend.net"): 2, ("good.org", "cdn.net"): 1, ("friend.net", "good.org"): 1, ("bad.com", "prey.net"): 1, ("lure.net", "bad.com"): 2}
    tree = {}
    for h in ("good.org", "friend.net", "cdn.net", "bad.com", "prey.net", "lure.net", "alone.info"):
        up = h.split(".")[1]
        tree[h, up] = tree[up, h] = 1
    assert got == links | tree
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, rounds=60).collect()}
    trust, distrust = ranks(got, {"good.org": 1.0}, False, 60), ranks(got, {"bad.com": 1.0}, True, 60)
    for i, url, _ in PAGES:
        host = brute.url(url, [])[0]
        assert found[i]["trust"] == pytest.approx(trust.get(host, 0), abs=1e-6) and found[i]["distrust"] == pytest.approx(distrust.get(host, 0), abs=1e-6)
    # what links to a blocked host is distrusted, what a trusted host links to is trusted
    assert [found[i]["verdict"] for i in (1, 2, 3, 4, 8, 6, 7)] == ["allow", "allow", "block", "block", "allow", "allow", "allow"]


def settled(spark, edges, trusted, blocked):
    """Hosts whose distrust is above their trust, by ``spread`` and by solving for the ranks."""
    import numpy as np

    rows = [(a, b, float(w)) for (a, b), w in edges.items()]
    seeds = [(h, trusted.get(h, 0.0), blocked.get(h, 0.0)) for h in {*trusted, *blocked}]
    got = url_filter.spread(spark.createDataFrame(rows, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")).collect()
    hosts = sorted({h for e in edges for h in e} | {*trusted, *blocked})
    at = {h: i for i, h in enumerate(hosts)}
    exact = []
    for links, start in ((edges, trusted), ({(b, a): w for (a, b), w in edges.items()}, blocked)):
        step = np.zeros((len(hosts), len(hosts)))
        for (a, b), w in links.items():
            step[at[b], at[a]] += w / sum(x for (c, _), x in links.items() if c == a)
        s = np.array([start.get(h, 0.0) for h in hosts]) / sum(start.values())
        exact.append(np.linalg.solve(np.eye(len(hosts)) - 0.85 * step, 0.15 * s))
    return {r["host"] for r in got if r["distrust"] > r["trust"]}, {h for h in hosts if exact[1][at[h]] > exact[0][at[h]]}


def test_verdicts_at_the_end_of_a_chain(spark):
    """Sixty steps from the only seeds: trust runs down one chain, distrust up the other."""
    edges = {(f"t{i:02d}", f"t{i + 1:02d}"): 1 for i in range(60)} | {(f"d{i + 1:02d}", f"d{i:02d}"): 1 for i in range(60)}
    got, want = settled(spark, edges, {"t00": 1.0}, {"d00": 1.0})
    assert got == want == {f"d{i:02d}" for i in range(61)}


def test_verdicts_of_near_ties(spark):
    """Both sides reach the middle by a chain; weights part them by a few millionths."""
    edges = {("good", "a"): 1, ("a", "mid"): 1_000_000, ("a", "x"): 1_000_003, ("mid", "b"): 1_000_000, ("y", "b"): 1_000_001, ("b", "bad"): 1, ("mid", "c"): 1, ("e", "mid"): 1}
    got, want = settled(spark, edges, {"good": 1.0}, {"bad": 1.0})
    assert got == want and "mid" in want


# ---- op7

def test_bad_rows_are_rejected(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge_quality(docs, labels).join(labels, "doc_id").filter("not base_failed and quality is not null").select("quality", "kept").collect()
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert bad.count(False) >= 0.85 * len(bad) and good.count(False) <= 0.02 * len(good)


def test_stage_agrees_with_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in quality.judge_quality(docs, labels).filter("kept").collect()}
    assert {r["doc_id"] for r in quality.drop_rejected(docs, labels).select("doc_id").collect()} == kept


# ---- op8

@pytest.mark.parametrize("options", [{}, {"broadcast_anchors": 0}])
def test_many_rows_without_id_and_copies(spark, options):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    common_part = [word() for _ in range(40)]
    rows = []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = common_part[rng.randrange(20):]
        rows.append((None if i % 2 else i // 7, " ".join(w)))
    rows += rows[:40]
    got = sorted(((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.repeat_digests(spark.createDataFrame(rows, DOCS).repartition(5), **options).collect()))
    assert got == sorted((str(d), *x) for (d, _), x in zip(rows, brute.repeats(rows)))


def test_clashing_names_everywhere(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(d, t, 1, 2, 3, 4, 5, 6) for d, t in ((1, text), (2, text), (2, text), (None, "short"))]
    docs = spark.createDataFrame(rows, DOCS + ", marks int, mark_id int, MARK_TEXT int, n_tokens int, fp int, no_id int")
    cut = substring.cut_repeats(docs)
    assert cut.columns == docs.columns and sorted(len(r["text"].split()) for r in cut.collect()) == [0, 0, 1, 30]
    alone = simhash.drop_near_copies(docs)
    assert alone.columns == docs.columns and sorted(str(r["doc_id"]) for r in alone.collect()) == ["1", "None"]
    assert token_counts.token_counts(docs, queries.piece_model()).count() == 4
    assert packing.unpack_rows(packing.pack_documents(docs, queries.piece_model())).count() == 4
    pages = spark.createDataFrame([(1, "http://a.org/", "<p>", "x", "y"), (1, "http://a.org/", "<p>", "x", "y")], "page_id long, url string, html string, host string, verdict string")
    assert [tuple(r)[:4] for r in url_filter.judge_urls(pages).collect()] == [(1, "a.org", "/", "org/")] * 2
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# ---- op9

def test_many_languages_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 40)
    rng = random.Random(1)
    rows = []
    for k in range(60):
        syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(2)) for _ in range(12)]
        for j in range(12 if k < 40 else 6):
            rows.append((1000 * k + j, " ".join("".join(rng.choices(syllables, k=2)) for _ in range(60)), f"l{k:02d}"))
    rows += [(99_001, rows[0][1] * 400, "l00"), (99_002, None, None), (99_002, "12 34", None)]
    got = langid.predict_languages(spark.createDataFrame(rows, DOCS + ", lang string").repartition(4)).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    held = [(lang, pred[d]) for d, _, lang in rows if lang and lang < "l40"]
    assert len(got) == len(rows) and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert set(pred.values()) <= {f"l{k:02d}" for k in range(40)} | {"und"} and pred[99_001] == "l00" and pred[99_002] == "und"


# ---- sums

def test_fold_over_many_parts(spark):
    import numpy as np

    rows = spark.createDataFrame([(np.array([i, 1], np.int64).tobytes(),) for i in range(100)], "a binary")
    assert common.tree_sum(rows.repartition(60), np.int64).tolist() == [4950, 100]
    assert common.tree_sum(rows.limit(0), np.int64) is None
