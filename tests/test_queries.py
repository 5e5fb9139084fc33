"""Every registered query with SQL gives what DuckDB gives; the others give rows of a stable schema."""

import duck
import pytest

from quillgraph.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return duck.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, connection, name):
    duck.same(spark, connection, sf, QUERIES[name], SQL[name])


#: Queries whose rule SQL can't state: their operators are tested against plain Python in test_operators, test_rules and
#: test_scale; here they run over the tables, and give rows.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and not df.isEmpty()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark, sf):
    out = registry.flagship(spark, sf)
    assert out.columns == ["doc_id", "score", "rank", "source"] and out.count() == 10
