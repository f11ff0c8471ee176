import pytest
from compare import connect, differences

from folio.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, data, con, name):
    assert differences(catalog.queries()[name](spark, data), con, catalog.oracle_sql()[name]) == ""
