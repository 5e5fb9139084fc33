"""Connected components of edge tables, by alternating star contractions, and of members that share hubs.

`connected_components` is native: a node's edges meet in one task only as partial minima, but for the join that gives
them the minimum. So that no node has very many edges there, `components_of_members` contracts first: members lie
dealt by their number, each task unites the hubs that its members share, and only pairs of hubs go on. A hub that a
third of all members have comes out of a task once, however many of them the task has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

_BLOCK = 2_000_000  # pairs that are contracted at once


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: long u, v (any order, repeats and loops allowed). One row per node: node, label (least node that it
    reaches). Each round is written to the checkpoint folder; rounds grow with the logarithm of the longest path."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = now.filter("u = v")
    now = now.filter("u <> v")
    if now.isEmpty():
        return loops.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(most_rounds):
        # Large star: larger neighbours move to the least neighbour. Small star: smaller ones do.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.distinct())
        # Done if these are stars: no node has two edges to lesser nodes, or edges both ways.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"no convergence in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("label")))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots).groupBy("node").agg(F.min("label").alias("label"))


def least_of_component(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the edges a[i], b[i]."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        apart = x != y
        if not apart.any():
            return p
        np.minimum.at(p, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs sorted by member, in blocks of whole members: of each member and each hub the least hub that it
    reaches within the block. `part` names the block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    part = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0

    def block(member: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        hubs, at = np.unique(hub, return_inverse=True)
        members, of = np.unique(member, return_inverse=True)
        least = least_of_component(at, of + len(hubs), len(hubs) + len(members))
        is_hub = np.arange(len(least)) < len(hubs)
        names = ["node", "is_hub", "part", "root"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([hubs, members])), pa.array(is_hub), pa.array(np.full(len(least), part)), pa.array(hubs[least])], names=names)

    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if sum(len(m) for m, _ in held) >= _BLOCK:
            member, hub = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(np.searchsorted(member, member[-1]))  # the last member may go on
            held = [(member[last:], hub[last:])]
            if last:
                yield block(member[:last], hub[:last])
                part += 1
    if held:
        yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))


def components_of_members(pairs: DataFrame) -> DataFrame:
    """pairs: long member, hub (numbers of their own each; repeats allowed). One row per member: member, label (least
    hub reached over members that share hubs)."""
    dealt = pairs.select("member", "hub").repartition("member").sortWithinPartitions("member")
    local = cut(dealt.mapInArrow(_contract, "node long, is_hub boolean, part long, root long"))
    links = connected_components(local.filter("is_hub and node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    labels = links.select(F.col("node").alias("root"), "label")
    # A block has a root once: what is joined to its members by block and root is no larger than the block.
    roots = cut(local.filter("is_hub and node = root").select("part", "root").join(labels, "root", "left").select("part", "root", F.coalesce("label", "root").alias("label")))
    return local.filter("not is_hub").select(F.col("node").alias("member"), "part", "root").join(roots, ["part", "root"]).select("member", "label")
