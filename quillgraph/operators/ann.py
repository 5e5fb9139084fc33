"""A stored index for nearest neighbours: cells in order, codes of half a byte a dimension, vectors for re-ranking.

Every row has a code: what its vector has beyond the centroid of its cell, in sixteen steps a dimension. Codes are sorted
by cell, and vectors by cell and id in small pages, in ranges over the whole table, so that a large cell lies in several
files. A search reads the codes of the cells that a query looks into (others are skipped by the scan's statistics), a
task keeping some times k rows for each query, and then the vectors of those rows alone: where they are few, pages
without any are skipped; where they are many, they are joined. How many cells to look into is measured when the index is
built, on the bounded sample that the centroids are fitted on; every row is in the index.
"""

from __future__ import annotations

import functools
import json
import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators.retrieval import unit_rows, vector_join
from quillgraph.session import cut, kept_folder

_STEPS = 16
_FEW = 2_000  # rows that are named in a filter, rather than joined
_NOWHERE = -1  # the cell of vectors without a direction, or of another width


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _floats(vectors: pa.Array) -> pa.Array:
    """Each vector's bytes as little-endian floats of 32 bits: a flat column, whose pages can be skipped one by one."""
    return pa.array([None if x is None else np.array(x, "<f4").tobytes() for x in vectors.to_pylist()], pa.binary())


def _lists(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else np.frombuffer(x, "<f4") for x in raw.to_pylist()], pa.list_(pa.float32()))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def fit_cells(table: DataFrame, cells: int | None = None, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means over `sample` rows at most (lowest hash of the id), and that sample. Cells grow
    with the square root of the table, from 16 to a sixteenth of the sample."""
    known = table.filter(F.col(vector_col).isNotNull())
    cells = cells or int(min(max(16, math.isqrt(known.count())), max(16, sample // 16)))
    rows = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow()[vector_col].combine_chunks()
    if not len(rows):
        return np.zeros((0, 1)), np.zeros((0, 1))
    v = unit_rows(rows, max(len(x) for x in rows.to_pylist()))
    v = v[np.abs(v).sum(axis=1) > 0]
    if not len(v):
        return np.zeros((0, 1)), np.zeros((0, 1))
    c = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
    for _ in range(rounds):
        at = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                m = v[at == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c, v


def needed_share(centroids: np.ndarray, sample: np.ndarray, recall: float = 0.98, k: int = 10, asked: int = 256) -> float:
    """The least share of the cells in which queries of the sample find that share of their k nearest of the sample."""
    if len(sample) <= k + 1 or not len(centroids):
        return 1.0
    q = sample[: min(asked, len(sample))]
    near = q @ sample.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-near, k, axis=1)[:, :k]
    of = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)  # of each cell for each query
    found = np.sort(np.take_along_axis(place, of[top], axis=1).ravel())
    return float(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)] + 1) / len(centroids)


def needed_candidates(centroids: np.ndarray, sample: np.ndarray, recall: float = 0.99, k: int = 10, asked: int = 256) -> int:
    """How many times k rows must be ranked by their vectors, for that share of the k nearest of the sample to be among
    the best by code; by half again, since neighbours lie closer in the whole table."""
    if len(sample) <= k + 1 or not len(centroids):
        return 3
    q = sample[: min(asked, len(sample))]
    own = np.arange(len(q))
    near, coded = q @ sample.T, q @ decode(*encode(sample, centroids), centroids).T
    near[own, own] = coded[own, own] = -np.inf
    top = np.argpartition(-near, k, axis=1)[:, :k]
    place = np.sort(np.take_along_axis(np.argsort(np.argsort(-coded, axis=1), axis=1), top, axis=1).ravel())
    return max(2, math.ceil(1.5 * (place[math.ceil(recall * len(place)) - 1] + 1) / k))


def encode(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, scale and packed code of each unit vector."""
    cell = (v @ centroids.T).argmax(axis=1)
    rest = v - centroids[cell]
    scale = np.maximum(np.abs(rest).max(axis=1), 1e-12)
    step = np.clip(np.floor((rest / scale[:, None] + 1) * (_STEPS / 2)), 0, _STEPS - 1).astype(np.uint8)
    if step.shape[1] % 2:
        step = np.hstack([step, np.zeros((len(step), 1), np.uint8)])
    return cell, scale.astype(np.float32), step[:, 0::2] | step[:, 1::2] << 4


def decode(cell: np.ndarray, scale: np.ndarray, code: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = np.empty((len(code), 2 * code.shape[1]), np.uint8)
    step[:, 0::2], step[:, 1::2] = code & 15, code >> 4
    rest = (step[:, : centroids.shape[1]] + 0.5) * (2 / _STEPS) - 1
    return _unit(centroids[cell] + rest * scale[:, None])  # of length 1 as the vectors are: less error along them


@dataclass(frozen=True)
class Index:
    folder: str
    centroids: np.ndarray
    share: float
    oversample: int
    codes: DataFrame  # cell, id, scale, code
    rows: DataFrame  # cell, id, v, grp


def build(table: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, cells: int | None = None, sample: int = 4096, page: int = 8) -> Index:
    """Writes the index of a table to a new folder that all executors reach. `group_col`: kept for filters; `page`: rows of
    a page of vectors. Vectors that are null, zero or of another width
    than the widest of the sample lie in a cell of their own, which only exact searches read."""
    centroids, fitted = fit_cells(table, cells, sample, id_col, vector_col)
    width = centroids.shape[1]

    def place(batches):
        for batch in batches:
            v = unit_rows(batch.column(1), width)
            real = np.abs(v).sum(axis=1) > 0
            cell, scale, code = (x.copy() for x in encode(v, centroids)) if len(centroids) else (np.zeros(len(v), np.int64), np.zeros(len(v), np.float32), np.zeros((len(v), 1), np.uint8))
            cell[~real] = _NOWHERE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(scale), _binary(code), _floats(batch.column(1)), batch.column(2)], names=["id", "cell", "scale", "code", "v", "grp"])

    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    source = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"), group.alias("grp"))
    placed = cut(source.mapInArrow(place, "id long, cell int, scale float, code binary, v binary, grp string").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
    for name, columns, rows in (("codes", ["cell", "id", "scale", "code"], 256), ("rows", ["cell", "id", "v", "grp"], page)):
        placed.select(*columns).write.option("parquet.page.row.count.limit", rows).option("parquet.enable.dictionary", "false").parquet(f"{folder}/{name}")
    meta = json.dumps({"share": needed_share(centroids, fitted), "oversample": needed_candidates(centroids, fitted), "centroids": centroids.tolist()})
    table.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.parquet(f"{folder}/meta")
    return load(table.sparkSession, folder)


def kept_index(table: DataFrame, name: str, **how: object) -> Index:
    """The index of a table, built once in a session, and anew when the table's files have changed."""
    folder = kept_folder(table.sparkSession, f"{name} {sorted(how.items())}", [table], lambda path: build(table, path, **how))
    return load(table.sparkSession, folder)


_TABLES = {"codes": "cell int, id long, scale float, code binary", "rows": "cell int, id long, v binary, grp string"}


def load(spark: SparkSession, folder: str) -> Index:
    meta = json.loads(spark.read.parquet(f"{folder}/meta").first()[0])
    c = np.array(meta["centroids"], np.float64)
    return Index(folder, c.reshape(len(c), -1) if len(c) else np.zeros((0, 1)), meta["share"], meta["oversample"], *(spark.read.schema(kind).parquet(f"{folder}/{name}") for name, kind in _TABLES.items()))


def _any(tests: list[Column]) -> Column:
    """One of the tests holds; a tree of low depth, however many there are."""
    while len(tests) > 1:
        tests = [functools.reduce(operator.or_, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _runs(cells: list[int]) -> Column:
    """The cell is one of these, as ranges, which the scan's statistics are compared with."""
    starts = [c for c in cells if c - 1 not in cells]
    ends = [c for c in cells if c + 1 not in cells]
    return _any([F.col("cell").between(a, b) for a, b in zip(starts, ends, strict=True)])


def _candidates(index: Index, ids: np.ndarray, asked: np.ndarray, many: int, share: float) -> DataFrame:
    """query_id, id, cell, approx of the `many` best codes for each query, out of the cells that it looks into."""
    probes = max(1, math.ceil(share * len(index.centroids)))
    probed = np.zeros((len(asked), len(index.centroids)), bool)
    np.put_along_axis(probed, np.argsort(-(asked @ index.centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    wanted = np.flatnonzero(probed.any(axis=0))
    centroids = index.centroids

    def find(batches):
        best = np.full((len(asked), many), -np.inf)
        who, where = np.zeros((len(asked), many), np.int64), np.zeros((len(asked), many), np.int32)
        for batch in batches:
            of, cell, scale = (batch.column(i).to_numpy() for i in (0, 1, 2))
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(of), -1)
            for at in range(0, len(of), 1_000):
                mine = slice(at, at + 1_000)
                score = asked @ decode(cell[mine], scale[mine], code[mine], centroids).T
                score[~probed[:, cell[mine]] | (ids[:, None] == of[mine][None, :])] = -np.inf
                n = score.shape[1]
                both = np.hstack([best, score])
                order = np.argsort(-both, axis=1, kind="stable")[:, :many]
                best = np.take_along_axis(both, order, axis=1)
                who = np.take_along_axis(np.hstack([who, np.broadcast_to(of[mine], (len(asked), n))]), order, axis=1)
                where = np.take_along_axis(np.hstack([where, np.broadcast_to(cell[mine], (len(asked), n))]), order, axis=1)
        row, col = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(who[row, col]), pa.array(where[row, col]), pa.array(best[row, col])], names=["query_id", "id", "cell", "approx"])

    codes = index.codes.filter(_runs(wanted.tolist())).select("id", "cell", "scale", "code")
    found = codes.mapInArrow(find, "query_id long, id long, cell int, approx double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("approx"), "id"))
    return found.withColumn("_n", best).filter(F.col("_n") <= many).drop("_n")


def _exactly(index: Index, found: DataFrame, queries: pa.Table, few: bool) -> DataFrame:
    """query_id, id, score, grp: the candidates by their vectors."""
    if few:
        rows = found.collect()
        if not rows:
            return found.select("query_id", "id", F.lit(0.0).alias("score"), F.lit("").alias("grp"))
        named = _any([(F.col("cell") == c) & (F.col("id") == i) for c, i in sorted({(r["cell"], r["id"]) for r in rows})])
        vectors = index.rows.filter(named).select("id", "v", "grp")
        found = found.sparkSession.createDataFrame([(r["query_id"], r["id"]) for r in rows], "query_id long, id long")
        both = vectors.join(F.broadcast(found), "id")
    else:
        both = index.rows.filter(F.col("cell") != _NOWHERE).select("id", "v", "grp").join(found.select("query_id", "id"), "id")
    ids = queries["query_id"].to_numpy()
    asked = unit_rows(queries["q"].combine_chunks(), index.centroids.shape[1])
    at = np.argsort(ids, kind="stable")

    def score(batches):
        for b in batches:
            mine = at[np.searchsorted(ids, b.column(0).to_numpy(), sorter=at)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((unit_rows(_lists(b.column(2)), asked.shape[1]) * asked[mine]).sum(axis=1)), b.column(3)], names=["query_id", "id", "score", "grp"])

    return both.select("query_id", "id", "v", "grp").mapInArrow(score, "query_id long, id long, score double, grp string")


def search(index: Index, queries: DataFrame, k: int, share: float | None = None, oversample: int | None = None, group: str | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2_000) -> DataFrame:
    """query_id, id, score, rank: the k nearest of each query, itself aside; ties by id. `share` of the cells is looked
    into, and `oversample` times k rows are ranked by their vectors (by default as measured for the index).

    With `group`, rows of other groups go after that; queries that are left with fewer than k are searched exactly within
    the group. Queries go out in blocks by hash, so that what is sent doesn't grow with them; a query without a direction
    finds nothing by the index, and is searched exactly."""
    share, oversample = index.share if share is None else share, oversample or index.oversample
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("q"))
    blocks = max(1, -(-q.count() // block))
    found: list[DataFrame] = []
    for i in range(blocks):
        mine = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()
        if not len(mine):
            continue
        asked = unit_rows(mine["q"].combine_chunks(), index.centroids.shape[1])
        real = np.abs(asked).sum(axis=1) > 0
        if real.any() and len(index.centroids):
            near = _candidates(index, mine["query_id"].to_numpy()[real], asked[real], k * oversample, share)
            found.append(_exactly(index, near, mine, len(mine) * k * oversample <= _FEW))
    empty = q.limit(0).select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("score"), F.lit("").alias("grp"))
    hits = functools.reduce(DataFrame.unionByName, found, empty)
    if group is not None:
        hits = hits.filter(F.col("grp") == group)
    top = cut(hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank"))
    enough = top.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = cut(q.join(enough, "query_id", "left_anti").select("query_id", "q"))
    if short.isEmpty():
        return top
    own = index.rows.filter(F.col("grp") == group) if group is not None else index.rows
    return top.join(enough, "query_id", "left_semi").unionByName(exact(short, own, k))


def exact(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank over all the rows (id, v)."""
    asked = queries.select(F.col("query_id").alias("id"), F.col("q").alias("v"))

    def lists(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(b.column(1))], names=["id", "v"])

    return vector_join(asked, rows.select("id", "v").mapInArrow(lists, "id long, v array<float>"), k, "id", "v")


def recall(found: DataFrame, true: DataFrame, k: int) -> float:
    """The share of the true k nearest that were found."""
    of = true.filter(F.col("rank") <= k).select("query_id", "id")
    hit = of.join(found.filter(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return hit / max(1, of.count())
