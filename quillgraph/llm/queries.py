"""The registered queries of this package: each applies one operator to its whole table, and derives digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import sql
from quillgraph.llm.conversations import damaged, repair_digests
from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.infill import fill_in_middle, restored
from quillgraph.llm.jaccard import near_duplicates
from quillgraph.llm.language import fit_language_model, identify_language
from quillgraph.llm.licenses import scan_licenses
from quillgraph.llm.likelihood import build_vocabulary, encode, score_encoded, train
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.quality import judge_quality, language_references
from quillgraph.llm.secrets import scan_secrets
from quillgraph.llm.sequences import read_documents, write_sequences
from quillgraph.llm.tokens import token_counts
from quillgraph.llm.urls import judge_urls
from quillgraph.session import checkpoint_dir, cut, table

try:
    import public_tokenizers
except ImportError:  # the vocabulary's path is a parameter of the operator; only the query has a default
    public_tokenizers = None


def contamination_digest(found: DataFrame) -> DataFrame:
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_benchmark_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, language_references(docs)).withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op5_link_graph_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = build_vocabulary(docs)
    encoded = cut(encode(docs, vocabulary))
    scored = score_encoded(encoded, train(encoded, vocabulary))
    return scored.withColumns({c: F.round(c, 4) for c in ("log_likelihood", "per_word")})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs, ~held_out(F.col("doc_id")))
    judged = identify_language(docs, model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def spans_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def op1_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    def count(kind: str) -> Column:
        return F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("parts", lambda p: p["strong"])
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("parts")).alias("spans"))


def op8_jaccard_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_license_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best_dice"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")), present="present")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c, 256).alias(name) for name, c in digests.items()])


def op13_arrow_sequences(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/sequences/{uuid.uuid4().hex}"
    write_sequences(table(spark, sf_dir, "documents"), folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, folder)


_ALL = [op1_secret_linking, op2_distribution_divergence, op3_token_counts, op4_temperature_mixing, op5_link_graph_propagation, op6_masked_pseudo_likelihood, op7_language_centroids, op8_jaccard_signature_trees, op9_license_bigrams, op10_benchmark_winnowing, op11_conversation_repair, op12_fill_in_middle, op13_arrow_sequences]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.ORACLES.items() if name in queries()}
