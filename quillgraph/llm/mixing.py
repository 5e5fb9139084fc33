"""Temperature mixing: source shares raised to an exponent, realised as permuted blocks of documents within a budget.

Weights are p ** a / sum(p ** a) of the token shares p. The exponent a (0: all sources alike, 1: as they are) is bisected
between 0 and 1: the entropy of the weights falls and no source is repeated more as it grows, so the largest exponent
whose entropy reaches the target is taken, or a larger one if a source would be repeated too often.

Documents of a source lie in blocks by a hash. Each epoch of a source has a permutation of its blocks; whole epochs give
every document once, and the last one is cut in the block where the budget ends, after the permuted documents that fit.

Cost: text is read once and only (id, source, tokens) goes on. Sums are partial before they are shuffled; the bisection
tries 31 exponents in one small job over the table of sources, which stays distributed (a table of `most_broadcast`
sources or fewer is sent to all tasks, so that rows of a large source need not meet to learn its number of blocks). A source of any size is spread
over its blocks, of which there are `most_blocks` at most: what is ordered in one task are a source's blocks, or the
documents of one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillgraph.session import cut

WORDS = r"[^\x20\x09-\x0D]+"


def _sections(shares: DataFrame, holds, rounds: int = 4) -> float:
    """Where `holds` (of sums at an exponent) changes from true at 0 to false at 1, by repeated division into 32."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        sums = _sums(shares, grid)
        true = [holds(a, sums[a]) for a in grid]
        if not true[0]:
            return low
        if all(true):
            return high
        at = true.index(False)
        low, high = grid[at - 1], grid[at]
    return low


def _sums(shares: DataFrame, grid: list[float]) -> dict[float, Row]:
    """At each exponent a: sum of p ** a (s), sum of p ** a * ln p (t), and the least and largest share. Exponents are
    rows, so that every round runs the same code."""
    p, power = F.col("share"), F.pow("share", "a")
    rows = shares.select("share", F.explode(F.array(*map(F.lit, grid))).alias("a"))
    sums = rows.groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.log(p)).alias("t"), F.min(p).alias("least"), F.max(p).alias("most"))
    return {r.a: r for r in sums.collect()}


def mixing_exponent(shares: DataFrame, entropy_share: float, max_repeats: float, budget_share: float | None) -> float:
    """The exponent for a table with the positive shares of sources. `entropy_share`: the target, as a part of the
    largest entropy (that of equal weights). `budget_share`: the budget as a part of all tokens; None: the least budget
    with which every document is used at least once."""
    n = shares.count()
    if n < 2:
        return 1.0

    def entropy(a, r):
        return math.log(r.s) - a * r.t / r.s

    def repeats(a, r):
        least, most = r.least ** (a - 1) / r.s, r.most ** (a - 1) / r.s  # weight over share, at the smallest and largest source
        return least / most if budget_share is None else least * budget_share

    level = _sections(shares, lambda a, r: entropy(a, r) >= entropy_share * math.log(n) - 1e-12)
    # Too many repeats at 0 but not at 1: the exponent where that ends, from above.
    if repeats(0.0, _sums(shares, [0.0])[0.0]) <= max_repeats:
        return level
    low = _sections(shares, lambda a, r: repeats(a, r) > max_repeats)
    return max(level, min(1.0, low + 2.0**-20))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokens: Column | None = None,
    entropy_share: float = 0.97,
    max_repeats: float = 4.0,
    budget_share: float | None = None,
    block_tokens: int = 1 << 16,
    most_blocks: int = 1 << 16,
    seed: int = 0,
    most_broadcast: int = 20_000,
) -> DataFrame:
    """One row per use of a row of docs: id, source, n_tokens, epoch (from 0), block, and slot: where its block begins
    in the source's part of the mixture (0 to 1), so that all sources ordered by slot keep their weights throughout.

    `tokens`: a column of docs with counts; by default the words of the text (null: none). A null source is a source of
    its own. A source without tokens has no weight, and its documents are used once. Repeated rows are used each, alike.
    Empty tables give no rows; other columns are ignored and may have any names.
    """
    count = F.coalesce((tokens if tokens is not None else F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS))).cast("long"), F.lit(0).cast("long"))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count.alias("n")))
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))  # null-safe key
    rows = rows.withColumn("key", named)
    sources = cut(rows.groupBy("key").agg(F.sum("n").alias("total")))
    whole = sources.agg(F.sum("total")).first()[0] or 0
    shares = cut(sources.filter("total > 0").select("key", "total", (F.col("total") / F.lit(max(whole, 1))).alias("share")))
    a = mixing_exponent(shares, entropy_share, max_repeats, budget_share)
    norm = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("s"), F.max(F.pow("share", F.lit(1 - a))).alias("m")).first()
    # With no budget given, the source with the largest share over weight (s * p ** (1 - a)) is used exactly once.
    budget = whole * (budget_share if budget_share is not None else (norm.s or 0) * (norm.m or 0))
    quota = F.floor(F.pow(F.col("total") / F.lit(max(whole, 1)), F.lit(a)) / F.lit(norm.s or 1.0) * budget + 1e-6)
    if budget_share is None:  # each document at least once, whatever the rounding of large products
        quota = F.greatest(quota, F.col("total"))
    plan = sources.select(
        "key",
        "total",
        F.when(F.col("total") > 0, quota).otherwise(0).cast("long").alias("quota"),
        F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens))).cast("long").alias("blocks"),
    )
    plan = plan.select("*", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(1).cast("int").alias("whole"), F.expr("if(total > 0, quota % total, 0)").alias("rest"))

    order = F.xxhash64(F.lit(seed), "id", "n")
    few = sources.limit(most_broadcast + 1).count() <= most_broadcast  # else the join is by shuffle, and may be split
    counts = plan.select("key", "blocks")
    rows = rows.join(F.broadcast(counts) if few else counts, "key").withColumn("block", F.pmod(order, F.col("blocks"))).drop("blocks")
    sizes = rows.groupBy("key", "block").agg(F.sum("n").alias("size"))
    steps = sizes.join(plan, "key").select("key", "block", "size", "total", "quota", "whole", "rest", F.explode(F.sequence(F.lit(0), "whole")).alias("epoch"))
    turn = Window.partitionBy("key", "epoch").orderBy(F.xxhash64(F.lit(seed), "key", "epoch", "block"), "block")
    before = F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.select("*", F.coalesce(before, F.lit(0)).alias("before"))
    # In the last, partial epoch blocks go on up to the one in which the rest ends.
    steps = steps.filter((F.col("epoch") < F.col("whole")) | (F.col("before") < F.col("rest"))).select(
        "key", "block", "epoch", F.when(F.col("epoch") == F.col("whole"), F.least(F.col("rest") - F.col("before"), "size")).otherwise(F.col("size")).alias("room"), "size",
        ((F.col("epoch") * F.col("total") + F.col("before")) / F.greatest("quota", F.lit(1))).alias("slot"),
    )
    used = rows.join(steps, ["key", "block"])
    full = used.filter("room = size")
    fit = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "id", "n"), "id").rowsBetween(Window.unboundedPreceding, 0)
    part = used.filter("room < size").withColumn("sofar", F.sum("n").over(fit)).filter("sofar <= room")
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("n").alias("n_tokens"), "epoch", "block", "slot"]
    return full.select(*columns).unionByName(part.select(*columns))
