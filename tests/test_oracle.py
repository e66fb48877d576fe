import importlib
import os

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(name) for name in entry._CORE]
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert oracle.compare(spark, FOLDER, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_repeats(spark, name):
    assert oracle.spark_rows(QUERIES[name](spark, FOLDER)) == oracle.spark_rows(QUERIES[name](spark, FOLDER))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
