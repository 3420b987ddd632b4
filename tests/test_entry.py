import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_registry():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and "taxonomy_score" in found


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["r", "c", "taxonomy_distance", "geo_score"]
