import os

import oracle
import pytest

from newsloom.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data folder")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    problem, n = oracle.compare(spark, oracle.connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None and n


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_row(spark, name):
    table, key = {"op3_warc": ("pages", "page_id"), "op11_embedding_dedup": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = QUERIES[name](spark, SF_DIR).select(key).distinct().count()
    assert ids == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
