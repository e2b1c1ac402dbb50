"""Every registered query against its SQL.

The folder is small by default, to keep the suite short; ORACLE_SF_DIR names another.
``python tests/oracle.py FOLDER`` does the same with times.
"""

import os

import pytest

import oracle
from newsloom import checks

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = checks.all_queries(), checks.all_oracles()
# covered by tests of their own; here they would repeat a training run
SLOW = {"model_train_full", "model_train_quick", "model_report", "model_sample_predictions", "model_scores", "page_scores"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no data folder")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem, _ = oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
