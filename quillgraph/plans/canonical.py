"""Canonical tables of the graph, built from the tables at hand. Each is one SQL text that Spark and DuckDB both run;
`{name}` stands for a base table.

vendor > product > source > article > episode is the structural chain; facts are bi-temporal edges between entities
(src, dst) with episodes as their provenance.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import registry
from quillgraph.plans.made_up import MADE_UP
from quillgraph.session import kept, kept_already, table

CANONICAL: dict[str, str] = {
    "vendor": "select cast(r_regionkey as bigint) as vendor_id, r_name as vendor from {region}",
    "product": "select cast(n_nationkey as bigint) as product_id, n_name as product, cast(n_regionkey as bigint) as vendor_id from {nation}",
    "source": "select c_custkey as source_id, c_name as source, cast(c_nationkey as bigint) as product_id, c_mktsegment as kind, c_acctbal as balance from {customer}",
    "article": """select o_orderkey as article_id, o_custkey as source_id, o_orderpriority as title, o_orderstatus = 'P' as removed, o_orderdate as changed_at,
        nullif(o_orderkey % 7, 0) as sort_order, o_totalprice as price from {orders}""",
    "episode": """select l_orderkey * 10 + l_linenumber as episode_id, l_orderkey as article_id, l_linenumber as chunk_index, max(l_returnflag) = 'R' as superseded,
        case when max(l_returnflag) = 'R' then max(l_shipdate) end as died_at, sum(l_quantity) as tokens from {lineitem} group by l_orderkey, l_linenumber""",
    "fact": """select l_orderkey * 1000000 + l_partkey as fact_id, l_partkey as src, min(l_suppkey) as dst, min(l_returnflag) as relation, min(o_orderdate) as valid_at,
        case when min(l_linestatus) = 'O' then null else greatest(max(l_shipdate), min(o_orderdate)) end as invalid_at, max(l_extendedprice) as score, l_orderkey as created
        from {lineitem} join {orders} on l_orderkey = o_orderkey group by l_orderkey, l_partkey""",
    "fact_episode": "select distinct l_orderkey * 1000000 + l_partkey as fact_id, l_orderkey * 10 + l_linenumber as episode_id from {lineitem}",
    "entity": "select p_partkey as entity_id, p_name as name, p_brand as label, p_type as kind, p_size as size, p_retailprice as price from {part}",
    "mention": "select distinct l_orderkey * 10 + l_linenumber as episode_id, l_partkey as entity_id from {lineitem}",
    "job": """select event_id as job_id, user_id as article_id, case when event_type in ('error') then 'dead' when event_type in ('signup', 'purchase') then 'done' when event_type = 'click' then 'in_progress' else 'pending' end as status,
        case when event_id % 3 = 0 then 'bootstrap' else 'incremental' end as lane, event_type as op, cast(event_id % 4 as bigint) as attempts, ts as enqueued_at, value as tokens, user_id % 20 as source_id, props from {events}""",
}
CANONICAL |= MADE_UP
#: The time at which facts are looked at, a parameter everywhere.
AS_OF = "1998-06-01"


def now(at: str = AS_OF) -> Column:
    return F.expr(f"timestamp_ntz'{at} 00:00:00'")


#: Canonical tables that take a shuffle to make: made once in a session, and read after that.
MADE_ONCE = {"episode", "fact", "fact_episode", "mention"}


class Tables:
    """Base and canonical tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in CANONICAL:
            return table(self.spark, self.sf_dir, name)
        parts = self._parts(name)
        make = lambda: self.spark.sql(CANONICAL[name], **parts)
        return kept(self.spark, f"{name} of {self.sf_dir}", make, list(parts.values())) if name in MADE_ONCE else make()

    def _parts(self, name: str) -> dict[str, DataFrame]:
        return {b: getattr(self, b) for b in sorted(set(re.findall(r"\{(\w+)\}", CANONICAL[name])))}

    def made(self, name: str) -> DataFrame:
        """A canonical table for queries that read few of its columns, once: it isn't kept for them, so that its other
        columns are neither shuffled nor written. If the session has kept it, it is read."""
        parts = self._parts(name)
        found = kept_already(self.spark, f"{name} of {self.sf_dir}", list(parts.values()))
        return found if found is not None else self.spark.sql(CANONICAL[name], **parts)


def oracle(sql: str) -> str:
    """The SQL with the canonical tables that it names, or that these name, in front."""
    used: set[str] = set()
    todo = [sql]
    while todo:
        more = {n for n in CANONICAL if n not in used and any(re.search(rf"\b{n}\b", text) for text in todo)}
        used |= more
        todo = [" ".join(re.findall(r"\{(\w+)\}", CANONICAL[n])) for n in more]
    ctes = [f"{n} as ({CANONICAL[n].format_map(_Same())})" for n in CANONICAL if n in used]
    if not ctes:
        return sql
    head, rest = re.match(r"\s*(with\s+recursive\s|with\s)?(.*)", sql, re.S | re.I).groups()
    start = "with recursive " if head and "recursive" in head.lower() else "with "
    return start + ",\n".join(ctes) + (",\n" if head else "\n") + rest


class _Same(dict):
    def __missing__(self, key):
        return key


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables."""

    def keep(f: Callable[[Tables], DataFrame]):
        registry.register(name, oracle(sql) if sql else None)(lambda spark, sf_dir: f(Tables(spark, sf_dir)))
        return f

    return keep
