"""Packed rows: round trips with repeated and missing ids, through binary files too."""

import os

import numpy as np
import pytest

from tessera.llm import packing, spm
from tessera.llm.queries import piece_model

ROWS = [(1, "first text"), (1, "second text"), (1, "first text"), (None, "third"), (None, "fourth " * 700), (None, None), (2, ""), (3, "x " * 3000)]


@pytest.fixture
def packed(spark):
    docs = spark.createDataFrame([(d, t, 5, "n") for d, t in ROWS], "doc_id long, text string, parts int, ids string").repartition(3)
    return packing.pack_documents(docs, piece_model(), row_tokens=512, batch_tokens=3000).persist()


def want():
    model = spm.load(piece_model()).model
    return sorted(((d, model.encode(t or "") + [2]) for d, t in ROWS), key=str)


def documents(rows):
    return sorted(((r["doc_id"], list(r["ids"])) for r in rows.collect()), key=str)


def test_repeated_and_null_ids_come_back(packed):
    got = packing.unpack_rows(packed)
    assert documents(got) == want() and got.select("doc_number").distinct().count() == len(ROWS)


def test_binary_files(spark, packed, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "FILE_ROWS", 3)
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        manifest = packing.write_binary(packed, folder)
        assert manifest.agg({"rows": "sum", "tokens": "sum"}).first()[0:2] is not None
        assert sum(r["rows"] for r in manifest.collect()) == packed.count()
        back = packing.read_binary(spark, folder)
        assert back.schema == packed.schema
        assert sorted(map(str, back.collect())) == sorted(map(str, packed.collect()))
        assert documents(packing.unpack_rows(back)) == want()
    names = [r["file"] for r in manifest.collect()]
    with np.load(os.path.join(tmp_path, "b", names[0])) as f:
        assert f["ids"].shape[1] == 512 and f["ids"].dtype == np.dtype("<u2")
        at = f["cu_seqlens_at"]
        first = f["cu_seqlens"][at[0]:at[1]]
        assert first[0] == 0 and first[-1] == f["n_tokens"][0] and len(f["position_resets"]) == len(f["doc_ids"])


def test_large_vocabularies_are_refused(spark, monkeypatch):
    monkeypatch.setattr(spm.load(piece_model()).model, "pieces", [("a", 0.0, 1)] * 70_000)
    with pytest.raises(ValueError, match="16 bits"):
        packing.pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), piece_model())
