"""Evaluation statistics."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.ordered import running


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p = F.try_divide(hits.cast("double"), n)
    mid, spread = p + z * z / (2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return F.try_divide(mid - spread, scale), F.try_divide(mid + spread, scale)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial tail, at most 1, for any number of pairs: the largest term as a logarithm, and the others
    as parts of it."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * (k - j + 1) / (n - k + j)  # the term before, from the largest down
        return F.struct((a["log"] + F.log((n - k + j) / j)).alias("log"), term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, start, step, lambda a: 2 * F.exp(a["log"] - n * math.log(2)) * a["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}


def majority(yes: Column, n: Column) -> Column:
    """Strict majority of two or more votes, else null."""
    return F.when((n >= 2) & (2 * yes != n), 2 * yes > n)


def at_rank(rows: DataFrame, group: str, value: str, rank: Callable[[Column], Column]) -> DataFrame:
    """group, value at a rank (from 1, of the number of values) in ascending order. The table is sorted in ranges, so that
    a group of any size is spread over tasks."""
    placed = running(rows.filter(F.col(value).isNotNull()).select(group, value), [group], [F.col(value)])
    return placed.filter(F.col("place") == rank(F.col("n"))).select(group, value)


def bootstrap_ratio(rows: DataFrame, over: str, under: str, id_col: str, reps: int = 200) -> DataFrame:
    """low, ratio, high: sum(over) / sum(under), and the 2.5th and 97.5th percentile over Poisson resamples, in which both
    sums have the same rows. A row's weight in a repetition is by a hash of both: rows are weighted where they lie, and
    only sums of a repetition are shuffled. Repetitions whose sum is 0 don't count."""
    u = F.conv(F.substring(F.md5(F.concat(F.col("rep").cast("string"), F.lit(":"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233  # Poisson(1) by its cumulative probabilities
    for k in range(8):
        total += term
        weight = weight + F.when(u > total, 1).otherwise(0)
        term /= k + 1
    drawn = rows.select(id_col, over, under, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).withColumn("w", weight)
    sums = drawn.groupBy("rep").agg(F.sum(F.col("w") * F.col(over)).alias("o"), F.sum(F.col("w") * F.col(under)).alias("u")).filter("u <> 0")
    r = sums.agg(F.array_sort(F.collect_list(F.col("o") / F.col("u"))).alias("r"))  # one number a repetition
    at = lambda q: F.get("r", F.least(F.size("r") - 1, F.floor(F.lit(q) * F.size("r"))).cast("int"))
    whole = rows.agg(F.try_divide(F.sum(over).cast("double"), F.sum(under)).alias("ratio"))
    return whole.join(F.broadcast(r)).select(at(0.025).alias("low"), "ratio", at(0.975).alias("high"))  # one row each


def bootstrap_mean(values: DataFrame, value_col: str, id_col: str, reps: int = 200) -> DataFrame:
    """low, mean, high of a column, as bootstrap_ratio() over the number of rows has them."""
    return bootstrap_ratio(values.select(id_col, value_col, F.lit(1).alias("_one")), value_col, "_one", id_col, reps).withColumnRenamed("ratio", "mean")
