"""Weighted samples against their SQL where texts are empty, or have no length."""

import duck
import duckdb
import pytest

from quillgraph.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module", params=[(3, 4), (1, 2)], ids=["many of length 0", "many without"])
def lengths(request, sf, tmp_path_factory):
    """Of five documents one or three are of length 0, three or one have none; some of the latter have no id."""
    zero, known = request.param
    folder = tmp_path_factory.mktemp("lengths")
    n = f"case when doc_id % 5 < {zero} then 0 when doc_id % 5 < {known} then n_chars end"
    doc = f"case when doc_id % 5 >= {known} and doc_id % 3 = 0 then null else doc_id end"
    duckdb.connect().execute(f"copy (select * replace ({n} as n_chars, {doc} as doc_id) from '{sf}/documents.parquet') to '{folder}/documents.parquet'")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", ["ds_6_weighted_sample", "ds_7_weighted_pick"])
def test_same_as_sql(spark, lengths, name):
    assert duck.same(spark, *lengths, QUERIES[name], SQL[name]) > 0
