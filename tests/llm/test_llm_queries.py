import pytest
from compare import compare

from logweave.llm import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if "doc_id" in df.columns:
        ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert {r.doc_id for r in rows} == ids
        if name != "op3_best_fit_packing":
            assert len(rows) == len(ids)
