import importlib
import os

import pytest

entry = importlib.import_module("__spark_entry__")
SMALL = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "balanced_budget" in queries


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
