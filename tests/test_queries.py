import pytest

from quern.plans import registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert differences(df, con, sql) is None
