"""Language identification: nearest of several centroids per language, by cosine of TF-IDF vectors of byte n-grams.

The classifier is fitted on a bounded sample of labelled rows (about `per_language` texts of each label, chosen by a
hash; with many labels fewer of each, so that there are about `most_rows` in all, but `least_rows` of each at least):
their n-gram counts are weighted by inverse document frequency and normalised, and each language's vectors are clustered
by spherical k-means. A text gets the language of the centroid with the highest cosine. It is rejected if its distance
(1 - cosine) exceeds what texts of about its length had in the sample, with a margin.

Cost: one pass to count labels, one to choose the sample (only its texts are moved), one to predict; no other shuffle.
The driver gets the counts of the sample that are not 0, and holds one label's vectors at a time. The model has
`clusters` centroids of 16 KB for each label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T

DIMS = 4096
_ROWS = 1024  # texts that are vectors at once
#: Bytes that are no part of n-grams (one separator stands for each): ASCII other than letters.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:128] = True
_SEPARATOR[97:123] = _SEPARATOR[65:91] = False
_FOLD = np.where(_SEPARATOR, 32, T.ASCII_LOWER).astype(np.uint8)


def features(chunk: T.Chunk) -> np.ndarray:
    """Counts of hashed byte 2-, 3- and 4-grams within each text (rows x DIMS); grams of two separators are left out."""
    x = _FOLD[chunk.data].astype(np.uint32)
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.offsets))
    out = np.zeros(chunk.rows * DIMS, np.float32)
    gap = np.zeros(max(len(x) - 1, 0), bool)
    gap[:] = (x[:-1] == 32) & (x[1:] == 32)
    gap |= row[:-1] != row[1:]
    for n in (2, 3, 4):
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        bad = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ x[j : j + m]) * np.uint32(0x01000193)
            if j < n - 1:
                bad |= gap[j : j + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        slot = (h >> np.uint32(20)).astype(np.int64) + row[:m] * DIMS
        out += np.bincount(slot[~bad], minlength=len(out)).astype(np.float32)
    return out.reshape(chunk.rows, DIMS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each centroid
    least: np.ndarray  # smallest accepted cosine by log2 of the number of n-grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm == 0, 1, norm)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, cosines and whether each is rejected."""
        if not self.languages:
            n = len(counts)
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        cos = self.vectors(counts) @ self.centroids.T
        best = cos.argmax(axis=1)
        top = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return self.owner[best], top, top < self.least[length_class(counts)]


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(np.int64), 19)


def _cluster(v: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; begins with the vector nearest the mean, then the one farthest from those chosen."""
    mean = v.mean(axis=0)
    chosen = [int((v @ mean).argmax())]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen].copy()
    for _ in range(rounds):
        at = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (mine := v[at == j]).size:
                s = mine.sum(axis=0)
                c[j] = s / max(float(np.linalg.norm(s)), 1e-12)
    return c


def fit(samples: dict[str, list[tuple[np.ndarray, np.ndarray]]], clusters: int = 3, rounds: int = 8, margin: float = 0.6) -> Model:
    """samples: for each label its texts, as the slots and values of their counts that are not 0. Texts are put in order
    of these, so that the model doesn't depend on the order in which they come."""
    names = sorted(samples)

    def matrix(name: str) -> np.ndarray:
        out = np.zeros((len(samples[name]), DIMS), np.float32)
        for row, (slots, values) in zip(out, sorted(samples[name], key=lambda t: (t[0].tobytes(), t[1].tobytes())), strict=True):
            row[slots] = values
        return out

    df = np.zeros(DIMS)
    for slots, _ in (t for name in names for t in samples[name]):
        df[slots] += 1
    total = sum(map(len, samples.values()))
    model = Model(names, np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), np.zeros(20))
    if not names:
        return model
    parts = [_cluster(model.vectors(matrix(name)), clusters, rounds) for name in names]
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    seen = [(model.vectors(x) @ model.centroids.T).max(axis=1) for x in map(matrix, names)]
    top, length = np.concatenate(seen), np.concatenate([length_class(matrix(name)) for name in names])
    for size in range(20):  # a low quantile of lengths up to a factor of two away, times the margin
        near = top[np.abs(length - size) <= 1]
        if len(near) >= 20:
            model.least[size] = margin * float(np.quantile(near, 0.02))
    return model


def fit_language_model(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 300,
    most_rows: int = 6000,
    least_rows: int = 20,
    clusters: int = 3,
) -> Model:
    """A model of the rows where `learn` holds and label and text are not null, and the text has a letter.

    The sample is the rows of lowest hash of id and text, about min(`per_language`, max(`least_rows`, `most_rows` /
    labels)) of each label (all, if there are fewer; rows that are alike count once). No rows: a model that rejects
    everything.
    """
    rows = docs.filter(learn).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    sizes = {r._lang: r["count"] for r in rows.groupBy("_lang").count().collect()}
    each = min(per_language, max(least_rows, most_rows // max(len(sizes), 1)))
    # The hash is uniform: below this part of its range lie about so many rows of a label. One lookup, for any labels.
    upto = [F.lit(x) for name, n in sorted(sizes.items()) for x in (name, int(min(1.0, each / n) * 2**64) - 2**63 - 1)]
    rows = rows.withColumn("_order", F.xxhash64("_id", "_text"))
    picked = (rows.filter(F.col("_order") <= F.create_map(*upto)[F.col("_lang")]) if sizes else rows.limit(0)).dropDuplicates(["_lang", "_order"])

    def vectorise(batches):
        for batch in batches:
            for c in T.chunks(batch.column(1), most_rows=_ROWS):
                x = np.minimum(features(c), 65535).astype(np.uint16)
                found = [np.flatnonzero(r).astype(np.uint16) for r in x]
                cols = [pa.array([f.tobytes() for f in found], pa.binary()), pa.array([r[f].tobytes() for r, f in zip(x, found, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), *cols], names=["_lang", "slots", "counts"])

    samples: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in picked.select("_lang", F.lower("_text").alias("_text")).mapInArrow(vectorise, "_lang string, slots binary, counts binary").collect():
        samples.setdefault(r._lang, []).append((np.frombuffer(r.slots, np.uint16), np.frombuffer(r.counts, np.uint16)))
    return fit(samples, clusters)


def identify_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each row of docs: id, lang_pred, score (cosine, 0 to 1) and rejected (too far from every centroid); with the
    columns in `keep` beside them.

    A null text, or one without a letter, is `und` with score 0, and rejected. Ties go to the label that sorts first.
    Repeated rows are judged each; other columns are ignored.
    """
    names = list(keep or [])
    source = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.lower(F.col(text_col).cast("string")), F.lit("")).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_ok"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]
    )
    carried = ["_id", *[f"_k{i}" for i in range(len(names))]]
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def judge(batches):
        for batch in batches:
            for c in T.chunks(batch.column(1), most_rows=_ROWS):
                which, score, far = model.predict(features(c))
                ok = np.asarray(batch.column(2).slice(c.first, c.rows)) & (which >= 0)
                lang = [model.languages[i] if good else "und" for i, good in zip(which.tolist(), ok.tolist(), strict=True)]
                kept = [batch.column(i).slice(c.first, c.rows) for i, f in enumerate(batch.schema) if f.name in carried]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(far | ~ok)], names=[*carried, "lang_pred", "score", "rejected"])

    out = source.mapInArrow(judge, ", ".join(f"{c} {types[c]}" for c in carried) + ", lang_pred string, score double, rejected boolean")
    return out.withColumnsRenamed({"_id": id_col} | {f"_k{i}": c for i, c in enumerate(names)})
