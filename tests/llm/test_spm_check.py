"""The check of encoded rows against the sentencepiece library."""

import pyarrow as pa
import pytest

from tessera.llm import spm
from tessera.llm.queries import piece_model

LATE = "word " * 40_000 + "end"


@pytest.fixture
def wrong(monkeypatch):
    """An encoder that gets the last id of the third row of a slice wrong."""
    real = spm.Encoder.slices

    def slices(self, column):
        for ch, ids, first in real(self, column):
            ids = ids.copy()
            ids[first[3] - 1] += 1
            yield ch, ids, first

    monkeypatch.setattr(spm.Encoder, "slices", slices)


def run(column, share):
    return list(spm._encoded(column, piece_model(), share))


def test_wrong_id_late_in_a_long_row(wrong):
    texts = pa.array(["first", "second " * 3000, LATE])
    with pytest.raises(ValueError, match="differs"):
        run(texts, 1.0)
    # a row off the common path is held against the library whatever the share
    with pytest.raises(ValueError, match="differs"):
        run(pa.array(["first", "second", "two  spaces " + LATE]), 0.0)
    assert run(texts, 0.0)


def test_share_of_rows():
    texts = pa.array([f"row {i} " + "x" * (i % 50) for i in range(4000)])
    (ch,) = list(spm.chunks(texts, spm.SLICE_BYTES))
    rows = spm._checked_rows(ch, pa.array([], pa.int64()).to_numpy(), 0.25)
    assert 850 < len(rows) < 1150 and rows.min() < 40 and rows.max() > 3960
    assert len(spm._checked_rows(ch, rows[:0], 1.0)) == 4000 and len(spm._checked_rows(ch, rows[:0], 0.0)) == 0


def test_all_rows_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert spm.piece_digests(docs, piece_model(), check_share=1.0).count() == docs.count()
