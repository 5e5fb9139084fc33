"""Duplicate entities: plans, survivors, and rewiring of the graph to them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.strings import fact_text_key
from quillgraph.session import cut


def merge_plan(entity: DataFrame, name_col: str, order: list[Column], id_col: str = "entity_id") -> DataFrame:
    """id, survivor of entities that share a name byte for byte; the survivor comes first in `order`, then by id.

    A window over names would gather a hot name in one task; minima of structs don't.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    best = entity.groupBy(name_col).agg(F.min(key).alias("best"), F.count("*").alias("copies")).filter("copies > 1")
    return entity.join(best, name_col).select(F.col(id_col), F.col("best.id").alias("survivor"), "copies")


def remap(edges: DataFrame, plan: DataFrame, columns: list[str], id_col: str = "entity_id") -> DataFrame:
    """Edges with both ends moved to survivors; ids, parallels and self-loops are kept."""
    moved = plan.filter(F.col(id_col) != F.col("survivor")).select(F.col(id_col).alias("_from"), F.col("survivor").alias("_to"))
    for c in columns:
        m = moved.select(F.col("_from").alias(f"_f_{c}"), F.col("_to").alias(f"_t_{c}"))
        edges = edges.join(m, F.col(c) == F.col(f"_f_{c}"), "left").withColumn(c, F.coalesce(f"_t_{c}", c)).drop(f"_f_{c}", f"_t_{c}")
    return edges


def near_names(entity: DataFrame, name_col: str = "name") -> DataFrame:
    """Names that differ in case or outer blanks only: key and number of spellings."""
    return entity.groupBy(F.lower(F.trim(F.col(name_col))).alias("key")).agg(F.count_distinct(name_col).alias("spellings")).filter("spellings > 1")


def _unit(vectors) -> np.ndarray:
    v = np.array(list(vectors), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def collapse_near_duplicates(items: DataFrame, block_col: str, threshold: float, order_col: str = "id", vector_col: str = "v", most: int = 20_000, text_col: str | None = None) -> DataFrame:
    """block, id, kept: in order, an item whose cosine with a survivor reaches the threshold, or whose text (in normal
    form, if `text_col` is given) is a survivor's, joins the first such one.

    The rule is sequential within a block. A block of more than `most` items is cut into ranges of the order, of up to
    `most` items each; in a round the next range of up to 8 blocks is collapsed, in one task each, and all tasks compare later
    items to the survivors it gave. What joined one of them leaves.
    """
    schema = f"{block_col} int, id long, kept long"
    key = F.xxhash64(fact_text_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))) if text_col else F.lit(None).cast("long")
    items = items.withColumn("_text", key)

    def collapse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        v = _unit(pdf[vector_col])
        kept, n, owner = np.empty_like(v), 0, []
        where: list[int] = []
        text, texts = pdf["_text"].to_numpy(), np.empty(len(v), np.int64)
        for i in range(len(v)):
            same = kept[:n] @ v[i] >= threshold - 1e-12
            near = np.flatnonzero(same | (texts[:n] == text[i]) if text_col else same)
            if len(near):
                owner.append(where[near[0]])
            else:
                kept[n] = v[i]
                texts[n] = text[i] if text_col else 0
                n += 1
                where.append(i)
                owner.append(i)
        ids = pdf[order_col].to_numpy()
        return pd.DataFrame({block_col: pdf[block_col].to_numpy(), "id": ids, "kept": ids[owner]})

    sizes = items.groupBy(block_col).count()
    large = cut(sizes.filter(F.col("count") > most).select(F.col(block_col).alias("_large")))
    if large.isEmpty():
        return items.groupBy(block_col).applyInPandas(collapse, schema)
    is_large = F.col(block_col).eqNullSafe(F.col("_large"))
    out = items.join(F.broadcast(large), is_large, "left_anti").groupBy(block_col).applyInPandas(collapse, schema)
    # Positions in sorted partitions give ranges of the order without a block's rows meeting in one task.
    left = items.join(F.broadcast(large), is_large, "left_semi").select(block_col, order_col, vector_col, "_text")
    left = cut(left.repartitionByRange(F.col(block_col), F.col(order_col)).sortWithinPartitions(block_col, order_col).withColumn("_range", F.floor(F.monotonically_increasing_id() / most)))
    while not left.isEmpty():
        turn = left.groupBy(F.col(block_col).alias("_b")).agg(F.min("_range").alias("_r"))
        now = F.col(block_col).eqNullSafe(F.col("_b")) & (F.col("_range") == F.col("_r"))
        turn = cut(turn.orderBy("_b").limit(8))  # blocks at once: their survivors are sent to all tasks
        done = cut(left.join(F.broadcast(turn), now, "left_semi").groupBy(block_col).applyInPandas(collapse, schema))
        later = left.join(F.broadcast(turn), now, "left_anti")
        survivors = done.filter("id = kept").select(F.col(block_col).alias("_b"), F.col("id").alias("_id"))
        fresh = left.join(survivors, F.col(block_col).eqNullSafe(F.col("_b")) & (F.col(order_col) == F.col("_id")), "left_semi")
        later = cut(_join_survivors(later, fresh, block_col, order_col, vector_col, threshold, text_col is not None))
        out = out.unionByName(done).unionByName(later.filter("_kept is not null").select(block_col, F.col(order_col).alias("id"), F.col("_kept").alias("kept")))
        left = later.filter("_kept is null").drop("_kept")
    return out


def _join_survivors(later: DataFrame, fresh: DataFrame, block_col: str, order_col: str, vector_col: str, threshold: float, by_text: bool, block: int = 1000) -> DataFrame:
    """later with _kept: of the survivors of its block the first whose cosine reaches the threshold, else null. Survivors
    are sent to all tasks in groups of one block's."""
    key = F.coalesce(F.col(block_col).cast("string"), F.lit("-"))
    packed = fresh.groupBy(key.alias("_key")).agg(F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("id"), F.col(vector_col).alias("v"), "_text"))).alias("s"))
    found = {r._key: (np.array([x.id for x in r.s]), _unit([x.v for x in r.s]), np.array([x._text or 0 for x in r.s])) for r in packed.toLocalIterator()}
    sent = later.sparkSession.sparkContext.broadcast(found)

    def match(batches):
        for pdf in batches:
            kept = np.full(len(pdf), -1, np.int64)
            owner = np.full(len(pdf), None, object)
            names = np.array(["-" if pd.isna(b) else str(int(b)) for b in pdf[block_col]])
            for name in np.unique(names):
                if name not in sent.value:  # a block of another round
                    continue
                ids, s, texts = sent.value[name]
                rows = np.flatnonzero(names == name)
                for at in range(0, len(rows), block):
                    some = rows[at : at + block]
                    near = _unit(pdf[vector_col].iloc[some]) @ s.T >= threshold - 1e-12
                    if by_text:
                        near |= pdf["_text"].to_numpy()[some][:, None] == texts[None, :]
                    kept[some] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
                mine = rows[kept[rows] >= 0]
                owner[mine] = ids[kept[mine]]
            yield pdf.assign(_kept=pd.array(owner, "Int64"))

    types = {f.name: f.dataType.simpleString() for f in later.schema}
    return later.withColumn("_kept", F.lit(None).cast("long")).mapInPandas(match, ", ".join(f"{c} {t}" for c, t in types.items()) + ", _kept long")
