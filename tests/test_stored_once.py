"""A stored index shuffles texts once and postings once."""

from tessera.operators.stored import StoredIndex
from tessera.sources.shared import temporary
from tessera.sources.tables import table

DATA = "/root/testdata/sf0.01"


def test_rows_are_dealt_out_once(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        if path.endswith("/terms"):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    index = StoredIndex.build(docs, temporary(spark, "stored"), folders=8, block=64)
    (plan,) = plans
    above = plan[:plan.index("Generate")]
    assert above.count("Exchange hashpartitioning") == 1
    assert index.rows.select("folder").distinct().count() == 8 and index.phrase("of the").count() > 0
