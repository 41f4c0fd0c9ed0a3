import pytest

import __spark_entry__ as entry
from compare import difference, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    query = entry.queries()[name]
    if sql:
        assert difference(spark, con, query, sql, SF) == ""
    else:
        assert query(spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
