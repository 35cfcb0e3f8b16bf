import pytest

from ledgerloom import catalog
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
