"""Graph operators on edge tables: projections, communities, distances, matching of community layers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ordered import fold_groups
from quillgraph.session import Rounds, cut


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """a < b, weight: parallel edges as one; loops go."""
    return edges.filter(F.col(src) != F.col(dst)).groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.count("*").alias("weight"))


def degrees(projected: DataFrame) -> DataFrame:
    both = projected.select(F.col("a").alias("node"), "weight").unionByName(projected.select(F.col("b").alias("node"), "weight"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


_PAIRS = 4_000_000  # pairs of nodes that a task holds at a time


def reached_in_two(edges: DataFrame, block: int = 500_000) -> DataFrame:
    """src, reached: to how many nodes one edge or two lead from each node. edges: src, dst, whole numbers.

    Nodes are dealt out in ranges of about `block` edges. What the ends of a range's edges lead to comes to the range once,
    however many of its nodes share an end, and a task counts there: pairs of nodes are not shuffled.
    """
    both = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src is not null and dst is not null")
    parts = max(1, -(-both.count() // block))
    e = cut(both.distinct().repartitionByRange(parts, "src").select("*", F.spark_partition_id().alias("block")))
    ends = e.select(F.col("block").alias("at"), F.col("dst").alias("mid")).distinct()
    beyond = ends.join(e.select(F.col("src").alias("mid"), F.col("dst").alias("end")), "mid").select("at", "mid", "end")
    return e.groupBy("block").cogroup(beyond.groupBy("at")).applyInArrow(_count_reached, "src long, reached long")


def _count_reached(edges: pa.Table, beyond: pa.Table) -> pa.Table:
    src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    mid, end = beyond["mid"].to_numpy(), beyond["end"].to_numpy()
    order = np.argsort(mid, kind="stable")
    mid, end = mid[order], end[order]
    kinds, code = np.unique(np.concatenate([dst, end]), return_inverse=True)
    direct, end = code[: len(dst)], code[len(dst) :]
    low = np.searchsorted(mid, dst)
    n = np.searchsorted(mid, dst, "right") - low
    firsts = np.flatnonzero(np.diff(src, prepend=src[0] - 1))
    bounds, reached, at = np.append(firsts, len(src)), np.zeros(len(firsts), np.int64), 0
    work = np.concatenate([[0], np.cumsum(n + 1)])[bounds]  # before each node
    while at < len(firsts):
        to = max(at + 1, int(np.searchsorted(work, work[at] + _PAIRS, "right")) - 1)
        lo, hi = bounds[at], bounds[to]
        if to == at + 1:  # a node by itself, with any number of ends
            seen = np.zeros(len(kinds), bool)
            seen[direct[lo:hi]] = True
            for i in range(lo, hi):
                seen[end[low[i] : low[i] + n[i]]] = True
            reached[at] = seen.sum()
        else:
            node = np.searchsorted(firsts, np.arange(lo, hi), "right") - 1 - at
            many, start = n[lo:hi], low[lo:hi]
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - start, many)
            key = np.unique(np.concatenate([node * len(kinds) + direct[lo:hi], np.repeat(node, many) * len(kinds) + end[place]]))
            reached[at:to] = np.bincount(key // len(kinds), minlength=to - at)
        at = to
    return pa.table({"src": src[firsts], "reached": reached})


_EDGES = 1_000_000  # ends of edges that a task reads


def _ends(projected: DataFrame, table: Rounds) -> DataFrame:
    """node, other, weight, turn (0 or 1, a half of the nodes): each edge from both of its ends, a loop once. Written by a
    hash of `other`, so that what is known of that node comes to the edges, which aren't shuffled for it."""
    back = projected.filter("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")
    ends = projected.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(back)
    return table.dealt(ends.withColumn("turn", _turn()), "other", "turn", _parts(2 * projected.count(), projected))


def _turn() -> Column:
    return F.pmod(F.xxhash64("node"), F.lit(2)).cast("int")


def _parts(edges: int, df: DataFrame) -> int:
    return min(100_000, max(df.sparkSession.sparkContext.defaultParallelism, -(-edges // _EDGES)))  # Spark allows no more buckets


def _strengths(projected: DataFrame) -> DataFrame:
    """node, strength: weights of its edges; a loop counts twice."""
    ends = projected.select(F.col("a").alias("node"), "weight").unionByName(projected.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("strength"))


def modularity(projected: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (node, label) of a graph (a, b, weight; loops may be there)."""
    total = projected.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
    inside = projected.join(of("a"), "a").join(of("b"), "b").filter("la = lb").agg(F.sum("weight")).first()[0] or 0
    mass = _strengths(projected).join(labels, "node").groupBy("label").agg(F.sum("strength").cast("double").alias("s"))
    return inside / total - resolution * (mass.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0) / (4.0 * total * total)


def _moved(ends: DataFrame, nodes: DataFrame, total: float, rounds: int, resolution: float, table: Rounds) -> DataFrame:
    """node, label, strength after nodes (node, label, strength) moved to where the weight of their edges less resolution *
    strength * label's strength / total is largest (ties: least label). Nodes move in alternate halves, by parity of a
    hash, so that pairs don't swap for ever, and only edges of the half whose turn it is are looked at; it ends early when
    neither half moves."""
    still, parts = 0, _parts(ends.count() // 2, ends)
    for r in range(rounds):
        mass = nodes.groupBy("label").agg(F.sum("strength").alias("mass"))
        # A label's mass goes with it to the neighbours; these come to their node once, for all that is asked of them there.
        known = table(nodes.join(mass, "label").select("node", "label", "mass", "strength"))
        to = known.select(F.col("node").alias("other"), "label", "mass").hint("shuffle_hash")
        near = ends.filter((F.col("turn") == r % 2) & (F.col("node") != F.col("other"))).join(to, "other").select("node", "label", "mass", "weight", F.lit(-1).alias("strength"))
        own = known.filter(_turn() == r % 2).select("node", "label", "mass", F.lit(0).alias("weight"), "strength")
        near = own.unionByName(near).repartition(parts, "node")
        kind = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
        best = near.mapInArrow(_best(float(resolution), float(total)), f"node {kind['node']}, label {kind['label']}, strength {kind['strength']}, now {kind['label']}")
        stay = known.filter(_turn() != r % 2).select("node", "label", "strength", F.col("label").alias("now"))
        moved = table(best.unionByName(stay))
        still = still + 1 if moved.filter("label <> now").isEmpty() else 0
        nodes = moved.select("node", "label", "strength")
        if still == 2:
            break
    return nodes


def _best(resolution: float, total: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, label (the best), strength, now of a task's nodes, from rows of their neighbours (node, label, mass, weight;
    strength -1) and one of each itself (weight 0, and its strength)."""

    def codes(values: pa.ChunkedArray) -> np.ndarray:
        array = values.to_numpy()
        return array if array.dtype.kind == "i" else np.unique(array, return_inverse=True)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not any(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        node, label = codes(rows["node"]), codes(rows["label"])
        order = np.lexsort((label, node))
        node, label, mass, weight, strength = node[order], label[order], *(rows[c].to_numpy()[order] for c in ("mass", "weight", "strength"))
        of_node = np.diff(node, prepend=node[0] - 1) != 0
        pairs = np.flatnonzero(of_node | (np.diff(label, prepend=label[0] - 1) != 0))  # of a node and a label
        firsts = np.flatnonzero(of_node[pairs])  # of each node, among them
        many = np.diff(np.append(firsts, len(pairs)))
        its = np.maximum.reduceat(strength, pairs)
        s = np.maximum.reduceat(its, firsts)
        # A node's own strength doesn't weigh on its own community.
        rest = mass[pairs] - np.where(its < 0, 0, its)
        gain = np.round(np.add.reduceat(weight, pairs) - resolution * np.repeat(s, many) * rest / total, 9)
        top = gain == np.repeat(np.maximum.reduceat(gain, firsts), many)
        place = np.minimum.reduceat(np.where(top, np.arange(len(pairs)), len(pairs)), firsts)
        best, now = order[pairs[place]], order[pairs[np.flatnonzero(its >= 0)]]
        out = {"node": rows["node"].take(pa.array(best)), "label": rows["label"].take(pa.array(best)), "strength": s, "now": rows["label"].take(pa.array(now))}
        yield from pa.table(out).to_batches(max_chunksize=100_000)

    return run


def propagate_labels(projected: DataFrame, rounds: int = 5, resolution: float = 1.0) -> DataFrame:
    """node, community by weighted label propagation with a modularity-like penalty. Sums are partial before they are
    shuffled; each round is written to the checkpoint folder."""
    table = Rounds(projected.sparkSession)
    nodes = table(_strengths(projected).withColumn("label", F.col("node")))
    total = nodes.agg(F.sum("strength")).first()[0] or 1
    out = cut(_moved(_ends(table(projected), table), nodes, total, rounds, resolution, table).select("node", F.col("label").alias("community")))
    table.clear()
    return out


def _refined(ends: DataFrame, nodes: DataFrame, total: float, resolution: float, rounds: int, table: Rounds) -> DataFrame:
    """node, part: connected parts of the communities of nodes (node, label, strength). Nodes begin alone; in each round a
    part picks the neighbour in its community from which modularity gains most, if it gains, and joins it if that one's
    number is less and it joins no other itself. Two that gain most from each other always join, so that it ends when
    nothing gains. A part grows by whole connected parts along edges, so that it is connected. The parts and the ties
    between them are the graph that shrinks from round to round."""
    own = lambda end: nodes.select(F.col("node").alias(end), F.col("label").alias(f"l{end}")).hint("shuffle_hash")
    # A tie is a row, part < to: what joining gains is the same for both.
    ties = ends.filter("node < other").join(own("other"), "other").join(own("node"), "node").filter("lnode = lother")
    ties = table(ties.select(F.col("node").alias("part"), F.col("other").alias("to"), "weight"))
    parts, mass = nodes.select("node", F.col("node").alias("part")), nodes.select(F.col("node").alias("part"), F.col("strength").alias("s"))
    for _ in range(rounds):
        gain = F.round(F.col("weight") - F.lit(resolution) * F.col("s") * F.col("s2") / F.lit(float(total)), 9)
        open_ = ties.join(mass, "part").join(mass.select(F.col("part").alias("to"), F.col("s").alias("s2")), "to").select("part", "to", gain.alias("gain")).filter("gain > 0")
        open_ = open_.select(F.explode(F.array(F.struct("part", "to", "gain"), F.struct(F.col("to").alias("part"), F.col("part").alias("to"), "gain"))).alias("o")).select("o.*")
        down = table(open_.groupBy("part").agg(F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("into")).filter("into < part"))
        joins = table(down.join(down.select(F.col("part").alias("into")), "into", "left_anti").select("part", "into"))
        if joins.isEmpty():
            break
        goes = lambda df, c: df.join(joins.select(F.col("part").alias(c), F.col("into").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: E731, B023
        parts = table(goes(parts, "part"))
        mass = table(goes(mass, "part").groupBy("part").agg(F.sum("s").alias("s")))
        ties = table(goes(goes(ties, "part"), "to").filter("part <> to").groupBy(F.least("part", "to").alias("part"), F.greatest("part", "to").alias("to")).agg(F.sum("weight").alias("weight")))
        if ties.isEmpty():
            break
    return parts.select("node", "part")


def communities(edges: DataFrame, levels: int = 3, min_size: int = 3, resolution: float = 1.0, src: str = "src", dst: str = "dst", moves: int = 4, merges: int = 10) -> DataFrame:
    """node, level (0 finest), community, size: modularity by moves, refinement and aggregation, in rounds over all nodes.

    At each level nodes move between communities; each community is refined into connected parts; and these are the nodes
    of the next level, which begin in the community that they are parts of. The parts of a level are its communities:
    they are connected, and nest in those of the level above. It ends early when a level joins nothing. Every round is
    some aggregations of the edges; what runs through the driver are counts."""
    table = Rounds(edges.sparkSession)
    graph = table(undirected(edges, src, dst))
    labels, member, out, known = None, None, None, -1
    for level in range(levels):
        nodes = _strengths(graph)
        nodes = table(nodes.join(labels, "node") if labels is not None else nodes.withColumn("label", F.col("node")))
        member = member if member is not None else nodes.select("node", F.col("node").alias("community"))
        total = nodes.agg(F.sum("strength")).first()[0] or 1
        ends = _ends(graph, table)
        moved = _moved(ends, nodes, total, moves, resolution, table)
        parts = table(_refined(ends, moved, total, resolution, merges, table))
        member = table(member.join(parts.select(F.col("node").alias("community"), "part"), "community").select("node", F.col("part").alias("community")))
        n = parts.select("part").distinct().count()
        if n == known:
            break
        known = n
        one = member.select("node", F.lit(level).alias("level"), "community")
        out = one if out is None else out.unionByName(one)
        if level + 1 == levels:
            break
        labels = table(moved.join(parts, "node").groupBy("part").agg(F.min("label").alias("label")).withColumnRenamed("part", "node"))
        to = lambda end: parts.select(F.col("node").alias(end), F.col("part").alias(f"p{end}")).hint("shuffle_hash")
        joined = ends.filter("node <= other").join(to("other"), "other").join(to("node"), "node")
        graph = table(joined.groupBy(F.least("pnode", "pother").alias("a"), F.greatest("pnode", "pother").alias("b")).agg(F.sum("weight").alias("weight")))
    out = cut(out)
    table.clear()
    sizes = out.groupBy("level", "community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    return out.join(sizes, ["level", "community"]).select("node", "level", "community", "size")


def community_ids(members: DataFrame, level: str, community: str, node: str) -> DataFrame:
    """level, community, id: 16 hex digits of a hash over the level and the members' names in order. Members stream
    through the hash, so that a community of any size is no list."""

    def digest(key, rows):
        h = hashlib.sha1(f"{key[0]}:".encode())
        for i, r in enumerate(rows):
            h.update(("," if i else "").encode() + r["_name"].encode())
        yield (*key, h.hexdigest()[:16])

    names = members.select(F.col(level).cast("int").alias("level"), F.col(community).cast("string").alias("community"), F.col(node).cast("string").alias("_name"))
    return fold_groups(names, ["level", "community"], ["_name"], digest, "level int, community string, id string")


def hierarchy(layers: DataFrame) -> DataFrame:
    """level, community, parent (of the level above), members, id (a hash of level and members)."""
    up = layers.select("node", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    grouped = layers.join(up, ["node", "level"], "left").groupBy("level", "community").agg(F.min("parent").alias("parent"), F.count("*").alias("members"))
    ids = community_ids(layers, "level", "community", "node")
    return grouped.join(ids, ["level", "community"]).select("level", "community", "parent", "members", "id")


def distances(edges: DataFrame, centre: int, depth: int = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, distance (0 to depth) from the centre over undirected edges: one join a step, none for a whole path."""
    both = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).unionByName(edges.select(F.col(dst).alias("u"), F.col(src).alias("v"))).distinct())
    seen = edges.sparkSession.createDataFrame([(centre, 0)], "node long, distance int")
    for step in range(1, depth + 1):
        front = seen.filter(F.col("distance") == step - 1)
        new = both.join(front, both["u"] == front["node"]).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = cut(seen.unionByName(new.withColumn("distance", F.lit(step))))
    return seen


def jaccard_pairs(fresh: DataFrame, kept: DataFrame, tau: float) -> DataFrame:
    """fresh, kept, level, jaccard of communities (tables of level, community, node) that share members, from tau."""
    size = lambda t, name: t.groupBy("level", F.col("community").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    common = fresh.select("level", "node", F.col("community").alias("fresh")).join(kept.select("level", "node", F.col("community").alias("kept")), ["level", "node"])
    common = common.groupBy("level", "fresh", "kept").agg(F.count("*").alias("both"))
    out = common.join(size(fresh, "fresh"), ["level", "fresh"]).join(size(kept, "kept"), ["level", "kept"])
    return out.select("level", "fresh", "kept", (F.col("both") / (F.col("n_fresh") + F.col("n_kept") - F.col("both"))).alias("jaccard")).filter(F.col("jaccard") >= tau)


def match_communities(fresh: DataFrame, kept: DataFrame, tau: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching: best pairs first (ties by ids). Pairs that are best for both sides are what greedy would
    take, so that rounds of mutual best give its result without a loop over pairs."""
    left = cut(jaccard_pairs(fresh, kept, tau))
    done = left.limit(0)
    while not left.isEmpty():  # the best pair of all is taken in each round, so that it ends
        order = F.struct((-F.col("jaccard")).alias("j"), "fresh", "kept")
        of_fresh = left.groupBy("level", "fresh").agg(F.min(order).alias("best")).select("level", "fresh", F.col("best.kept").alias("kept"))
        of_kept = left.groupBy("level", "kept").agg(F.min(order).alias("best")).select("level", F.col("best.fresh").alias("fresh"), "kept")
        best = cut(left.join(of_fresh, ["level", "fresh", "kept"]).join(of_kept, ["level", "fresh", "kept"]))
        done = cut(done.unionByName(best))
        left = cut(left.join(best.select("level", "fresh"), ["level", "fresh"], "left_anti").join(best.select("level", "kept"), ["level", "kept"], "left_anti"))
    return done
