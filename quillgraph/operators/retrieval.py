"""Search: vector similarity, reciprocal rank fusion, neighbours of hits, diverse selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V


def scored(table: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score (cosine) of every row; null, zero or unequally long vectors score 0. A task multiplies its vectors with
    the query as matrices."""
    asked = unit_rows(pa.array([query], pa.list_(pa.float64())), len(query))[0]
    source = table.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unit_rows(b.column(1), len(asked)) @ asked)], names=["_id", "score"])

    return source.mapInArrow(score, f"_id {source.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def vector_search(table: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, score (cosine) of the k nearest; ties by id. Exact: one scan, and k rows of each task are shuffled."""
    return scored(table, query, id_col, vector_col).orderBy(F.desc("score"), id_col).limit(k)


def vector_join(
    queries: DataFrame, table: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 5_000, group_col: str | None = None
) -> DataFrame:
    """query_id, id, score, rank: the k nearest of each of a stated set of queries, exact; ties by id. Null, zero or
    unequally long vectors score 0. With `group_col` (whole numbers) only rows of the query's group are searched.

    Queries go to the tasks in blocks of about `block`, so that what is sent doesn't grow with them; a task multiplies
    its vectors with a block as matrices, and keeps k rows of a query before anything is shuffled.
    """
    blocks = max(1, -(-queries.count() // block))
    own = [F.col(group_col).cast("long").alias("g")] if group_col else []
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("q"), *own)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), *own)
    if group_col:  # null is no group
        q, rows = q.filter("g is not null"), rows.filter("g is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = None
    for i in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()
        ids = part["query_id"].to_numpy()
        if not len(ids):
            continue
        vectors = part["q"].combine_chunks()
        asked = unit_rows(vectors, pc.max(pc.list_value_length(vectors)).as_py() or 1)
        groups = part["g"].to_numpy() if group_col else None
        best = rows.mapInArrow(_nearest(ids, asked, k, groups), "query_id long, id long, score double")
        top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out if out is not None else rows.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of length 1 as rows; missing ones, and those of another width, are 0."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    out = np.zeros((len(vectors), width))
    flat = pc.fill_null(vectors.filter(fits).flatten().cast(pa.float64()), 0.0)
    out[np.asarray(fits)] = np.asarray(flat).reshape(-1, width)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


_CELLS = 1_000_000  # scores that a task holds at a time


def _nearest(query_ids: np.ndarray, asked: np.ndarray, k: int, groups: np.ndarray | None = None):
    """For a task: of each query the k best of its rows (of its group, if there are groups), ties by id."""
    n = len(asked)
    step = max(k, min(1_000, _CELLS // n))

    def find(batches):
        best, who = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
        for batch in batches:
            every, vectors = np.asarray(batch.column(0)), batch.column(1)
            for at in range(0, batch.num_rows, step):
                ids = every[at : at + step]
                score = asked @ unit_rows(vectors.slice(at, step), asked.shape[1]).T
                score[query_ids[:, None] == ids[None, :]] = -np.inf  # not itself
                if groups is not None:
                    score[groups[:, None] != np.asarray(batch.column(2))[at : at + step][None, :]] = -np.inf
                some = np.flatnonzero((score >= best[:, -1:]).any(axis=1))  # queries that these rows may matter to
                both, was = np.hstack([best[some], score[some]]), who[some]
                # All that reach a query's k-th score, by score and id; the k first of each.
                row, col = np.nonzero((both >= np.partition(both, -k, axis=1)[:, -k][:, None]) & (both > -np.inf))
                of = np.where(col < k, was[row, np.minimum(col, k - 1)], ids[np.maximum(col - k, 0)])
                order = np.lexsort((of, -both[row, col], row))
                row, col, of = row[order], col[order], of[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < k
                best[some] = -np.inf
                best[some[row[kept]], place[kept]], who[some[row[kept]], place[kept]] = both[row[kept], col[kept]], of[kept]
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(who[row, col]), pa.array(best[row, col])], names=["query_id", "id", "score"])

    return find


def worst_cosine(items: DataFrame, group: str, block: int = 1_000) -> DataFrame:
    """group, worst: the least cosine of two items of a group (of two or more). items: group, id, v.

    A group is dealt out in parts of about `block` rows by a hash, and each pair of parts meets in one task, which
    multiplies them: a row goes to as many tasks as its group has parts, and what comes out is one number each.
    """
    sizes = items.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.count("*").alias("n")).filter("n > 1").drop("n")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = items.join(sizes, group).select(group, "v", part.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select(group, "v", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    kind = items.schema[group].dataType.simpleString()

    def worst(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.array(pdf["v"].tolist(), np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        own, a, b = pdf["own"].to_numpy(), int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        x, y = v[own == a], v[own == b]
        cos = x @ y.T
        least = cos[np.triu_indices(len(x), 1)].min(initial=np.inf) if a == b else cos.min(initial=np.inf)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "worst": [float(least)]})

    per = rows.groupBy(group, "a", "b").applyInPandas(worst, f"{group} {kind}, worst double")
    return per.groupBy(group).agg(F.min("worst").alias("worst"))


def ranked(hits: DataFrame, id_col: str, list_no: int, k: int) -> DataFrame:
    """The k best of a list with their places from 1."""
    top = hits.orderBy(F.desc("score"), id_col).limit(k)
    return top.select(F.col(id_col).alias("id"), F.lit(list_no).alias("list"), F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def rrf(lists: DataFrame, constant: int = 60) -> DataFrame:
    """lists: id, list, rank. id and score: sums of 1 / (constant + rank); pos: order by score, ties by first appearance."""
    scored = lists.groupBy("id").agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return scored.orderBy(F.desc(F.round("score", 12)), "first").select("id", "score", "first")


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1, doc_col: str = "article_id", order_col: str = "chunk_index") -> DataFrame:
    """Chunks of the same document within `reach` places of a hit, each once."""
    h = hits.select(F.col(doc_col).alias("_doc"), F.col(order_col).alias("_at"))
    near = (chunks[doc_col] == F.col("_doc")) & chunks[order_col].between(F.col("_at") - reach, F.col("_at") + reach)
    return chunks.join(h, near, "left_semi")


def diverse(hits: DataFrame, k: int, weight: float = 0.5, query_col: str = "query_id") -> DataFrame:
    """query, id, place: maximal marginal relevance. hits: query, id, score, v (bounded lists per query)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["v"].tolist(), np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (round(pdf["score"][i] - weight * near[i], 9), -i))
            left.remove(best)
            out.append(best)
            near = np.maximum(near, v @ v[best]) if len(out) > 1 else v @ v[best]
        return pd.DataFrame({query_col: pdf[query_col].iloc[0], "id": pdf["id"].iloc[out].to_numpy(), "place": range(1, len(out) + 1)})

    return hits.groupBy(query_col).applyInPandas(choose, f"{query_col} long, id long, place int")


def temporal_status(invalid_at: Column, as_of: Column, swept: Column | None = None) -> Column:
    ended = invalid_at.isNotNull() & (invalid_at <= as_of)
    return F.when(~ended, "current").when(swept if swept is not None else F.lit(False), "expired").otherwise("superseded")


def is_current(invalid_at: Column, as_of: Column) -> Column:
    """Ends in the future are still current."""
    return invalid_at.isNull() | (invalid_at > as_of)
