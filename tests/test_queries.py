"""Every query with SQL, on the smallest tables, against DuckDB; the others run."""

from pathlib import Path

import pytest
from compare import assert_same, connection

from loomdex.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    assert_same(catalog.QUERIES[name](spark, FOLDER), catalog.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
