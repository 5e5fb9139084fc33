"""Running sums and folds along an order, for groups of any size.

A window over a group gathers it in one task. `running` sorts the whole table in ranges instead: sums within a range
are a window over that range, and what lies before it is a sum over one row for each range and group. `fold_groups` is for
rules whose every step needs the one before: a group's rows stream through a small Python function in order, in one task
but never as a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.session import cut

_OUT = 10_000  # rows of a batch that a fold gives


def running(rows: DataFrame, groups: list[str], order: list[Column], value: Column | None = None) -> DataFrame:
    """rows with place (from 1, of its group in ascending order), before (sum of the values of earlier ones), n and total
    of its group. The order should be total; nulls come first, and are a group. A null value counts as 0."""
    sort = [f"_o{i}" for i in range(len(order))]
    v = F.coalesce(value, F.lit(0)) if value is not None else F.lit(0)
    dealt = rows.select("*", *[c.alias(name) for c, name in zip(order, sort, strict=True)], v.alias("_v")).repartitionByRange(*groups, *sort).sortWithinPartitions(*groups, *sort)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    ranges = dealt.groupBy("_p", *groups).agg(F.min("_i").alias("_first"), F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    earlier = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    ranges = ranges.select(
        F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_bs"),
        F.sum("_n").over(whole).alias("n"), F.sum("_s").over(whole).alias("total"),
    )
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy("_p", *groups).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_bs") + F.coalesce(F.sum("_v").over(within), F.lit(0))
    return dealt.join(ranges, same).select(*rows.columns, (F.col("_i") - F.col("_first") + F.col("_bn") + 1).alias("place"), before.alias("before"), "n", "total")


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[dict[str, Any]]], Iterable[tuple]], schema: str) -> DataFrame:
    """What `fold` yields for each key, given the key and its rows (as dicts) in order."""
    kind = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

        out: list[tuple] = []
        every = (r for b in batches for r in b.to_pylist())
        for key, group in groupby(every, key=lambda r: tuple(r[k] for k in keys)):
            for row in fold(key, group):
                out.append(row)
                if len(out) == _OUT:
                    yield batch(out)
                    out = []
        yield batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
