import os

import oracle
import pytest

from trackloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert oracle.compare(spark, FOLDER, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, FOLDER)) == oracle.spark_rows(QUERIES[name](spark, FOLDER))
