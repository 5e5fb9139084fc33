"""The queries of the llm package against their SQL, over the whole smallest tables."""

import duck
import pytest

from quillgraph.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return duck.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, connection, name):
    assert duck.same(spark, connection, sf, queries.queries()[name], SQL[name]) > 0


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))
