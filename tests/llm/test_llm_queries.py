import pytest

from shoebox.llm import queries
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    assert not differences(queries.QUERIES[name](spark, data), duck, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data.replace("sf0.001", "sf0.01")).count() > 0
