import os

import pytest

from tests.oracle import both, connect
from vellichor import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, wanted = both(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert got == wanted


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.queries()) - set(catalog.oracle_sql())):
        assert catalog.queries()[name](spark, FOLDER).count() > 0, name
