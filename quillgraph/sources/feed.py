"""Change feeds: parsing, pushed-down scans, hash gates, and sinks as pure functions of old and new tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """control string, next_since string, count int, change_type string, id string, topic_key string, source_id string, vendor string, product string,
    title string, source_url string, last_updated_at string, content_changed_at string, content_hash string, estimated_tokens int, sort_order int, removed_at string, run_id string, seq bigint"""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of newline-delimited JSON: line, the fields, and kind (content, tombstone, control or malformed). Blank
    lines go; unknown fields are ignored; malformed lines are kept for the dead-letter table."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumnRenamed("value", "line")
    return parse_records(lines)


def parse_records(lines: DataFrame) -> DataFrame:
    schema = F.from_json("line", RECORD + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    also = [c for c in lines.columns if c != "line"]
    parsed = lines.filter(F.trim("line") != "").select("line", *also, schema.alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    kind = F.when(bad, "malformed").when(F.col("r.control").isNotNull(), "control").when(F.col("r.change_type") == "removed", "tombstone").otherwise("content")
    return parsed.select("line", *also, "r.*", kind.alias("kind")).drop("_bad")


def pulled(records: DataFrame, by: str, cursor: str = "old_cursor") -> DataFrame:
    """Of parsed records, by feed: applied, malformed, clean (a terminal cursor came), and the cursor to go on from: the
    new one only after a clean end without malformed lines, else the old one."""
    g = records.groupBy(by).agg(
        F.count_if(F.col("kind").isin("content", "tombstone")).alias("applied"),
        F.count_if(F.col("kind") == "malformed").alias("malformed"),
        F.coalesce(F.bool_or((F.col("kind") == "control") & (F.col("control") == "cursor")), F.lit(False)).alias("clean"),
        F.max(F.when(F.col("control") == "cursor", F.col("next_since"))).alias("new"),
        F.max(cursor).alias("old"),
    )
    return g.select(by, "applied", "malformed", "clean", F.when(F.col("clean") & (F.col("malformed") == 0), F.col("new")).otherwise(F.col("old")).alias("cursor"))


def scan(df: DataFrame, equal: dict[str, Any], after: tuple[str, Any] | None = None) -> DataFrame:
    """Filters that reach the reader; a parameter that is None is left out."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.filter(F.col(after[0]) > after[1]) if after else df


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values where given, old ones elsewhere; rows of either."""
    o, n = old.alias("o"), new.alias("n")
    on = None
    for k in keys:
        one = F.col(f"o.{k}") == F.col(f"n.{k}")
        on = one if on is None else on & one
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns])


def replace_partition(old: DataFrame, new: DataFrame, parts: DataFrame) -> DataFrame:
    """Old rows outside of the parts (a table of their keys) and the new ones."""
    return old.join(parts, parts.columns, "left_anti").unionByName(new)


def hash_gate(old: DataFrame, new: DataFrame, key: str, hash_col: str) -> DataFrame:
    """New rows with changed: true if the key is new or its hash differs."""
    before = old.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"))
    same = F.coalesce(F.col(hash_col) == F.col("_hash"), F.lit(False))
    return new.join(before, F.col(key) == F.col("_key"), "left").withColumn("changed", ~same).drop("_key", "_hash")


def action(old_hash: Column, new_hash: Column, has_job: Column, has_episodes: Column) -> Column:
    """What an arriving record asks for: skip, requeue (same text, but never ingested), or enqueue."""
    same = F.coalesce(old_hash == new_hash, F.lit(False))
    return F.when(same & ~has_job & ~has_episodes, "requeue").when(same, "skip").otherwise("enqueue")
