"""Queries against their SQL where keys and times are as in larger tables: part keys of a million and more, so that facts
of two orders share an id; seconds with fractions, many to a user."""

import duck
import duckdb
import pytest

from quillgraph.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def large_keys(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("large_keys")
    c = duckdb.connect()
    rows = {t: f"select * from '{sf}/{t}.parquet'" for t in duck.TABLES}
    rows["lineitem"] += f" union all select * replace (l_orderkey - 1 as l_orderkey, l_partkey + 1000000 as l_partkey, (l_orderkey % 3 + 8)::int as l_linenumber) from '{sf}/lineitem.parquet' where l_orderkey > 1"
    rows["part"] += f" union all select * replace (p_partkey + 1000000 as p_partkey) from '{sf}/part.parquet'"
    rows["events"] += f" union all select * exclude (k) replace (event_id + k as event_id, 900000 + k // 1000000 as user_id, ts + to_microseconds(k * 7777) as ts) from '{sf}/events.parquet', range(1000000, 6000000, 1000000) r(k)"
    # A day apart but for what a second is rounded by, one way or the other; and halves, which go to the even second.
    rows["events"] += "".join(
        f" union all (select * replace ({9000000 + 2 * u + i} as event_id, {990000 + u} as user_id, timestamp '2024-01-0{i + 1} 00:00:00' + to_microseconds({us}) as ts) from '{sf}/events.parquet' limit 1)"
        for u, times in enumerate([(400_000, 600_000), (600_000, 1_400_000), (500_000, 1_500_000), (1_500_000, 2_500_000)]) for i, us in enumerate(times)
    )
    for t, text in rows.items():
        c.execute(f"copy ({text}) to '{folder}/{t}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["gr_12_staleness_sweep", "gr_6_merge_audit", "str_6_debounce", "join_19_support", "gr_6_merge_rewire"])
def test_same_as_sql(spark, large_keys, name):
    assert duck.same(spark, duck.connect(large_keys), large_keys, QUERIES[name], SQL[name]) > 0
