"""Streams: hash-gated change feeds, deduplication, windows over event time, debouncing. Each is a function of a
streaming (or batch) DataFrame; run_once() drains what is there, as a scheduled job would."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, as a stream takes no single file


def deduplicated(events: DataFrame, key: list[str], time_col: str, lateness: str) -> DataFrame:
    """Each key once within the lateness; state older than that goes."""
    return events.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time_col: str, lateness: str, length: str, slide: str | None, by: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Tumbling (no slide) or sliding windows: start, the columns in `by`, and the aggregates by name."""
    w = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    grouped = events.withWatermark(time_col, lateness).groupBy(w.alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("w.start").alias("start"), *by, *aggregates)


def sessions(events: DataFrame, time_col: str, lateness: str, gap: str, by: list[str]) -> DataFrame:
    w = F.session_window(time_col, gap)
    return events.withWatermark(time_col, lateness).groupBy(w.alias("w"), *by).agg(F.count("*").alias("events")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def debounced(events: DataFrame, key: str, time_col: str, seconds: int) -> DataFrame:
    """key, at: events that come more than `seconds` after the last one let through of their key. State: one time per key."""

    def step(k: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        passed = []
        for at in sorted(x for f in frames for x in f["at"]):
            if last is None or at - last > seconds:
                passed.append(at)
                last = at
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(passed), "at": passed})

    narrow = events.select(F.col(key), F.unix_timestamp(F.col(time_col).cast("timestamp")).alias("at"))
    return narrow.groupBy(key).applyInPandasWithState(step, f"{key} long, at long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None, until: Callable[[], bool] | None = None) -> None:
    """Process input batch by batch by `each`: all that is there, or, with `every` (as "5 seconds"), again and again at
    that interval until `until` holds: the poll loop. A later run goes on where the last one ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    running = writer.trigger(processingTime=every).start()
    try:
        while not (until and until()):
            if running.awaitTermination(0.2):
                break
    finally:
        running.stop()


def to_files(path: str, mode: str = "append") -> Callable[[DataFrame, int], None]:
    """A sink of Parquet files: each batch in a folder of its own (so that a repeated one replaces itself), or, for whole
    results, the last one."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    return write
