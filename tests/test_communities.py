"""Communities by moves, refinement and aggregation: connected, nested, and no worse than label propagation."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graphs as G
from quillgraph.session import Rounds


def planted(rng, groups, size, inside, across):
    nodes = range(groups * size)
    return [(a, b) for a in nodes for b in nodes if a < b and rng.random() < (inside if a // size == b // size else across)]


def components(nodes, edges):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in edges:
        if a in of and b in of:
            of[root(a)] = root(b)
    return len({root(n) for n in nodes})


def modularity(edges, of):
    """One edge and one community at a time."""
    m = len(edges)
    degree, inside = {}, 0
    for a, b in edges:
        degree[of[a]] = degree.get(of[a], 0) + 1
        degree[of[b]] = degree.get(of[b], 0) + 1
        inside += of[a] == of[b]
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


@pytest.fixture(scope="module", params=[(6, 12, 0.6, 0.02)])
def found(request, spark):
    edges = planted(random.Random(sum(map(ord, str(request.param)))), *request.param)
    df = spark.createDataFrame(edges, "src long, dst long")
    levels = {}
    for r in G.communities(df, levels=2, min_size=1).collect():
        levels.setdefault(r.level, {})[r.node] = r.community
    return edges, df, levels, request.param


def test_every_community_is_connected(found):
    edges, _, levels, _ = found
    for of in levels.values():
        for c in set(of.values()):
            members = {n for n, x in of.items() if x == c}
            assert components(members, edges) == 1


def test_levels_nest(found):
    _, _, levels, _ = found
    for low, high in zip(sorted(levels), sorted(levels)[1:], strict=False):
        up = {}
        for n, c in levels[low].items():
            assert up.setdefault(c, levels[high][n]) == levels[high][n]
        assert len(set(levels[high].values())) < len(set(levels[low].values()))


def test_modularity_is_that_of_label_propagation_at_least(spark, found):
    edges, df, levels, (groups, size, *_) = found
    top = levels[max(levels)]
    by_labels = {r.node: r.community for r in G.propagate_labels(G.undirected(df)).collect()}
    q = modularity(edges, top)
    assert q >= modularity(edges, by_labels) - 1e-9
    if groups > 1:
        assert q >= 0.8 * modularity(edges, {n: n // size for n in top})
    labels = spark.createDataFrame(list(top.items()), "node long, label long")
    assert G.modularity(G.undirected(df), labels) == pytest.approx(q)


def test_cliques_and_odd_graphs(spark):
    edges = [(a, b) for base in (0, 10, 20) for a in range(base, base + 6) for b in range(base, base + 6) if a < b] + [(5, 10), (15, 20), (3, 3), (1, 0)]
    got = {}
    for r in G.communities(spark.createDataFrame(edges, "src long, dst long"), levels=2).collect():
        got.setdefault(r.level, {})[r.node] = r.community
    top = got[max(got)]
    assert all(len({top[n] for n in range(base, base + 6)}) == 1 for base in (0, 10, 20)) and len(set(top.values())) == 3
    assert G.communities(spark.createDataFrame([], "src long, dst long")).count() == 0
    two = G.communities(spark.createDataFrame([(1, 2)], "src long, dst long"), min_size=2).filter(F.col("level") == 0).collect()
    assert len({r.community for r in two}) == 1 and {r.node for r in two} == {1, 2}


def test_a_round_of_moves_shuffles_edges_twice(spark, monkeypatch):
    """By the neighbour, for its label and that label's mass, and by the node, for all else."""
    plans, real = [], Rounds.__call__

    def seen(self, df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return real(self, df)

    monkeypatch.setattr(Rounds, "__call__", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for graphs of any size
    try:
        G.communities(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)], "src long, dst long"), levels=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = [p for columns, p in plans if "now" in columns]
    assert rounds and all(p.count("Exchange hashpartitioning") + p.count("Exchange SinglePartition") <= 4 for p in rounds)  # two of them of nodes


def test_a_round_of_moves_shuffles_edges_once_and_reads_a_half(spark, monkeypatch):
    """Edges lie by the neighbour, whose label comes to them; those of nodes whose turn it is go to their node."""
    plans, real = [], Rounds.__call__

    def seen(self, df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return real(self, df)

    monkeypatch.setattr(Rounds, "__call__", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = spark.catalog.listTables()
    try:
        G.communities(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)], "src long, dst long"), levels=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rounds = [p for columns, p in plans if "now" in columns]
    assert rounds and all(p.count("Exchange hashpartitioning") == 2 and "Sort" not in p and "PartitionFilters: [isnotnull(turn" in p for p in rounds)  # one of them of nodes
    assert spark.catalog.listTables() == tables


@pytest.mark.parametrize("names", [int, lambda n: -(n**3), "node {}".format], ids=["numbers", "negative", "strings"])
def test_moves_are_those_of_plain_python(spark, names):
    edges = [(names(a), names(b)) for a, b in planted(random.Random(5), 4, 8, 0.6, 0.08)]
    df = spark.createDataFrame(edges + edges[:9] + [(names(3), names(3))], ["src", "dst"])
    weights = {}
    for a, b in edges + edges[:9]:
        for pair in ((a, b), (b, a)):
            weights[pair] = weights.get(pair, 0) + 1
    strength = {}
    for (a, _), w in weights.items():
        strength[a] = strength.get(a, 0) + w
    nodes = spark.createDataFrame([(n,) for n in strength], ["node"])
    turn = {r.node: r.turn for r in nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(2)).alias("turn")).collect()}
    label, total = {n: n for n in strength}, sum(strength.values())
    for r in range(4):
        mass = {}
        for n, c in label.items():
            mass[c] = mass.get(c, 0) + strength[n]
        moved = dict(label)
        for n in strength:
            pull = {label[n]: 0}
            for (a, b), w in weights.items():
                if a == n:
                    pull[label[b]] = pull.get(label[b], 0) + w
            gain = {c: round(w - strength[n] * (mass[c] - (strength[n] if c == label[n] else 0)) / total, 9) for c, w in pull.items()}
            if turn[n] == r % 2:
                moved[n] = min(gain, key=lambda c: (-gain[c], c))
        label = moved
    assert {r.node: r.community for r in G.propagate_labels(G.undirected(df), rounds=4).collect()} == label
