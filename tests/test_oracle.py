"""Every query with SQL gives the same rows in Spark and DuckDB; the others run."""

import oracle
import pytest

from siftstone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert oracle.compare(df, sql, con) == ""
