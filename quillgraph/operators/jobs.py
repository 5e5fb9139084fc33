"""The job queue as functions of a table: enqueue, claim, complete, fail, reap, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.strings import backoff
from quillgraph.operators.ordered import fold_groups


def enqueue(pending: DataFrame) -> DataFrame:
    """One pending row per article: latest op, incremental lane if any asks for it, first known source."""
    return pending.groupBy("article_id").agg(
        F.max_by("op", F.struct("enqueued_at", "job_id")).alias("op"),
        F.when(F.bool_or(F.col("lane") == "incremental"), "incremental").otherwise("bootstrap").alias("lane"),
        F.min_by("source_id", "job_id").alias("source_id"),
    )


def claim(jobs: DataFrame, n: int) -> DataFrame:
    """The next n pending jobs: incremental lane first, then oldest."""
    order = [F.col("lane") == "bootstrap", "enqueued_at", "job_id"]
    return jobs.filter("status = 'pending'").orderBy(*order).limit(n).withColumn("status", F.lit("in_progress"))


def fail(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Jobs in progress after a failure: dead at `most` attempts, else pending again after a backoff (wait, seconds)."""
    tried = F.col("attempts") + 1
    return jobs.filter("status = 'in_progress'").select(
        "job_id", tried.alias("attempts"), F.when(tried >= most, "dead").otherwise("pending").alias("status"), F.when(tried < most, backoff(tried)).alias("wait")
    )


def complete(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs with those done that are listed in `done` (job_id, claimed_at), if they are still in progress under the same
    claim: a job that was reaped and claimed again belongs to someone else."""
    own = done.select("job_id", F.col("claimed_at").alias("_claim"), F.lit(True).alias("_done"))
    ends = F.col("_done") & (F.col("status") == "in_progress") & (F.col("claimed_at") == F.col("_claim"))
    return jobs.join(own, "job_id", "left").withColumn("status", F.when(ends, "done").otherwise(F.col("status"))).drop("_claim", "_done")


def defer(jobs: DataFrame, deferred: DataFrame, now: Column, seconds: int) -> DataFrame:
    """jobs with the listed ones (job_id, claimed_at) pending again, `seconds` from now and without a spent attempt. If
    the article has a pending job by now, that one covers it and the deferred job goes."""
    own = deferred.select("job_id", F.col("claimed_at").alias("_claim"), F.lit(True).alias("_later"))
    twins = jobs.filter("status = 'pending'").select("article_id", F.lit(True).alias("_twin")).distinct()
    x = jobs.join(own, "job_id", "left").join(twins, "article_id", "left")
    mine = F.coalesce(F.col("_later") & (F.col("status") == "in_progress") & (F.col("claimed_at") == F.col("_claim")), F.lit(False))
    x = x.withColumn("_mine", mine).filter(~(F.col("_mine") & F.col("_twin").isNotNull()))
    again = {"status": F.lit("pending"), "claimed_at": F.lit(None).cast("timestamp_ntz"), "next_at": now + F.expr(f"interval {seconds} seconds")}
    return x.withColumns({c: F.when(F.col("_mine"), v).otherwise(F.col(c)) for c, v in again.items()}).select(*jobs.columns)


def reap(jobs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Jobs in progress for longer than the lease go back."""
    expired = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("enqueued_at").cast("timestamp")) > lease_seconds
    return jobs.select("job_id", F.when((F.col("status") == "in_progress") & expired, "pending").otherwise(F.col("status")).alias("status"))


def debounce(events: DataFrame, key: str, time_col: str, seconds: int) -> DataFrame:
    """key, passed: how many events come more than `seconds` after the last one let through, of times rounded to whole
    seconds (halves to the even one): a key's times stream through a fold."""

    def passes(k, rows):
        last, n = None, 0
        for r in rows:
            if last is None or r["_at"] - last > seconds:
                last, n = r["_at"], n + 1
        yield (*k, n)

    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, F.rint(F.unix_micros(F.col(time_col).cast("timestamp")) / 1_000_000).cast("long").alias("_at")).filter("_at is not null")
    return fold_groups(timed, [key], ["_at"], passes, f"{key} {kind}, passed int")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
