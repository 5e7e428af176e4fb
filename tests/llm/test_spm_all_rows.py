"""Every row is held against the sentencepiece library unless a caller says otherwise."""

import pyarrow as pa
import pytest

from tessera.llm import spm
from tessera.llm.queries import piece_model


@pytest.mark.parametrize("n", range(12))
def test_no_wrong_row_passes(monkeypatch, n):
    real = spm.Encoder.slices

    def slices(self, column):
        for ch, ids, first in real(self, column):
            ids = ids.copy()
            ids[first[3] - 1] += 1
            yield ch, ids, first

    monkeypatch.setattr(spm.Encoder, "slices", slices)
    with pytest.raises(ValueError, match="differs"):
        list(spm._encoded(pa.array(["first", "second", f"plain row {n}"]), piece_model(), spm.CHECK_SHARE))
