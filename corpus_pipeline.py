"""Preparing a training corpus: stages that each apply one operator of quillgraph.llm to what the one before kept.

Every stage but the last returns the columns of documents. A stage handles nulls, empty tables and repeated rows as its
operator says; here only what follows from that for documents is told.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.jaccard import near_duplicates
from quillgraph.llm.language import fit_language_model, identify_language
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.queries import held_out
from quillgraph.llm.secrets import scan_secrets
from quillgraph.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected go: null, empty or without letters, or too far from every language. If no row has a
    label, nothing is learned, and all documents stay. Repeated rows are judged each, and alike."""
    model = fit_language_model(docs, ~held_out(F.col("doc_id")))
    if not model.languages:
        return docs.select(*COLUMNS)
    judged = identify_language(docs.withColumn("id", F.col("doc_id")), model, id_col="id", keep=COLUMNS)
    return judged.filter(~F.col("rejected")).select(*COLUMNS)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (without ids: smallest text hash).
    Rows with the same id and text stay once; texts without words stay, being linked with nothing."""
    found = cut(near_duplicates(docs))
    later = found.filter(~F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    kept = docs.join(later, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_anti")
    repeated = cut(found.filter(F.col("first") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    if not repeated.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return kept.select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; so do all if there
    are no items. Repeated rows are judged each, and alike."""
    judged = decontaminate(docs.withColumn("id", F.col("doc_id")), table(spark, sf_dir, "benchmark"), id_col="id", keep=COLUMNS)
    return judged.filter(F.size("spans") == 0).select(*COLUMNS)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a secret, or linked parts of a credential, are found go. Null and empty texts stay; repeated
    rows are judged each, and alike."""
    return scan_secrets(docs.withColumn("id", F.col("doc_id")), id_col="id", keep=COLUMNS).filter(F.size("parts") == 0).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The order of training: each document at least once, those of small sources more often. Null and empty texts have
    no tokens and are used once for each time their source is; a null source is a source of its own. Ties of the order
    go by hash and id, repeated rows are used each; no documents give no rows."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", first_of_group),
    ("decontamination", benchmark_free),
    ("secrets", secret_free),
    ("mixing", mixture),
]

#: Centroids fitted to the corpus can't be stated in SQL; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
