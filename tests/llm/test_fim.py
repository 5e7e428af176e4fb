"""Fill-in-middle against a plain version: units, forms, outputs, exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, queries

DOCS = "doc_id long, text string"


def plain(doc_id, text, grammar=fim.WORDS):
    text = text or ""
    unit = re.findall(grammar, text)
    assert "".join(unit) == text
    n = len(unit)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (unit[:lo], unit[lo:hi], unit[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(5)
    out = [(1, None), (2, ""), (None, "no id here"), (4, " "), (5, "\n\n a\r\n"), (6, "ends <P> here"), (7, "a<S>"), (8, "<<M"), (9, "<P"), (10, "S><M <S"), (11, "é𝒳 z 😀😀a b"), (12, "😀"), (13, "word"), (14, "x" * 200_000 + " y" * 50_000)]
    for i in range(300):
        out.append((100 + i, "".join(rng.choice("abC <>PSM\n.😀é") for _ in range(rng.randrange(40)))))
    return out + out[:3] + [(100, "another text under one id")]


def test_outputs_and_round_trips(spark):
    data = rows()
    got = fim.fill_in_middle(spark.createDataFrame(data, DOCS).repartition(3)).collect()
    want = sorted(((d, *plain(d, t)) for d, t in data), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    back = sorted((r["doc_id"] or -1, r["output_sha256"], r["restored_sha256"]) for r in fim.digests(spark.createDataFrame(data, DOCS)).collect())
    assert back == sorted((d or -1, digest(plain(d, t)[-1]), digest(t or "")) for d, t in data)


@pytest.mark.parametrize("grammar,text,want", [
    (fim.WORDS, "ab, c", ["ab", ",", " ", "c"]),
    (fim.CHARACTERS, "a😀\n", ["a", "😀", "\n"]),
    (fim.LINES, "a\n\nbc\nd", ["a\n", "\n", "bc\n", "d"]),
    (fim.LINES, "a\n", ["a\n"]),
    (r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+", "ab12 .c", ["ab", "1", "2", " .", "c"]),
])
def test_grammars(spark, grammar, text, want):
    assert re.findall(grammar, text) == want
    got = spark.createDataFrame([(text,), ("",), (None,)], "text string").select(fim.units(F.col("text"), grammar).alias("u")).collect()
    assert [r["u"] for r in got] == [want, [], []]


def test_bad_grammar():
    with pytest.raises(ValueError):
        fim.boundary("abc")


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7, "k"), (2, None, "y", 8, "l")], DOCS + ", form string, unit int, carried string")
    out = fim.transform(docs)
    assert out.columns == docs.columns + ["form_"]
    assert [(r["form"], r["unit"], r["carried"]) for r in out.collect()] == [("x", 7, "k"), ("y", 8, "l")]
    assert fim.digests(docs).count() == 2 and fim.digests(docs.limit(0)).count() == 0


def test_query_over_whole_table_without_shuffle(spark):
    df = queries.queries()["op13_fill_in_middle"](spark, "/root/testdata/sf0.01")
    assert df.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in df.collect():
        n, form, p, m, out = plain(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[1:6] == (n, form, p, m, hashlib.sha256(out.encode()).hexdigest())
