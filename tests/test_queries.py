import pytest

from shoebox.plans import registry
from tests.oracle import connect, differences

QUERIES, ORACLES = registry.collect("QUERIES"), registry.collect("ORACLES")


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert not differences(QUERIES[name](spark, data), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["kind", "id_a", "id_b"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
