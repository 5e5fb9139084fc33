"""Queue and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgraph.operators import jobs as J
from quillgraph.plans.canonical import query
from quillgraph.session import checkpoint_dir
from quillgraph.sources import feed
from quillgraph.streaming import feeds


def drain(t, stream, mode: str = "append"):
    """Run a stream over all of its input into files of the shared folder, and read these."""
    path = f"{checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"
    feeds.run_once(stream, f"{path}-state", feeds.to_files(f"{path}-out", mode), mode)
    return t.spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}-out")


def events_stream(t):
    """The events as a stream."""
    return feeds.read_table(t.spark, f"{t.sf_dir}/events.parquet", t.events).withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_3_hash_gate", """with o as (select doc_id, md5(text) as h from documents where lang <> 'fr'), n as (select doc_id, source, md5(case when source = 'src5' then text || 'x' else text end) as h from documents)
    select n.doc_id, case when o.h = n.h and source <> 'src7' then 'skip' when o.h = n.h then 'requeue' else 'enqueue' end as action from n left join o using (doc_id)""")
def _(t):
    o = t.documents.filter("lang <> 'fr'").select("doc_id", F.md5("text").alias("old"))
    n = t.documents.select("doc_id", "source", F.md5(F.when(F.col("source") == "src5", F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("new"))
    known = F.col("source") != "src7"
    return n.join(o, "doc_id", "left").select("doc_id", feed.action(F.col("old"), F.col("new"), known, F.lit(False)).alias("action"))


@query("str_4_lanes", "select article_id, case when exists (select 1 from episode where episode.article_id = article.article_id and not superseded) then 'incremental' else 'bootstrap' end as lane from article")
def _(t):
    live = t.episode.filter(~F.col("superseded")).select("article_id").distinct().withColumn("live", F.lit(True))
    return t.article.select("article_id").join(live, "article_id", "left").select("article_id", F.when(F.col("live"), "incremental").otherwise("bootstrap").alias("lane"))


@query("str_5_delivery_dedup", "select user_id, event_type, min(event_id) as event_id from events group by all")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("str_7_enqueue", """select article_id, max_by(op, (enqueued_at, job_id)) as op, case when bool_or(lane = 'incremental') then 'incremental' else 'bootstrap' end as lane, min_by(source_id, job_id) as source_id from job where status = 'pending' group by article_id""")
def _(t):
    return J.enqueue(t.job.filter("status = 'pending'"))


@query("str_8_claim", "select job_id, 'in_progress' as status from (select * from job where status = 'pending' order by lane = 'bootstrap', enqueued_at, job_id limit 25)")
def _(t):
    return J.claim(t.job, 25).select("job_id", "status")


@query("str_8_fail", "select job_id, attempts + 1 as attempts, case when attempts + 1 >= 3 then 'dead' else 'pending' end as status, case when attempts + 1 < 3 then least(30.0::double * pow(2.0, attempts), 3600) end as wait from job where status = 'in_progress'")
def _(t):
    return J.fail(t.job)


@query("str_9_reap", "select job_id, case when status = 'in_progress' and enqueued_at < timestamp '2024-01-20' - interval 7200 seconds then 'pending' else status end as status from job")
def _(t):
    return J.reap(t.job, F.expr("timestamp_ntz'2024-01-20 00:00:00'"), 7200)


@query("str_tumbling_windows", "select time_bucket(interval 1 hour, ts, timestamp '2024-01-01') as start, event_type, count(*) as n from events group by all")
def _(t):
    return t.events.groupBy(F.window("ts", "1 hour")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("str_sliding_windows", """with b as (select time_bucket(interval 6 hours, ts, timestamp '2024-01-01') as b, event_type from events), w as (select b as start, event_type from b union all select b - interval 6 hours, event_type from b)
    select start, event_type, count(*) as n from w group by all""")
def _(t):
    return t.events.groupBy(F.window("ts", "12 hours", "6 hours")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("str_session_windows", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g) select user_id, min(ts) as start, count(*) as events from s group by user_id, s""")
def _(t):
    w = F.session_window("ts", "6 hours")
    return t.events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


@query("str_streamed_counts", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def _(t):
    return drain(t, events_stream(t).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), "complete")


@query("str_streamed_dedup", "select user_id, event_type from events group by all")
def _(t):
    return drain(t, feeds.deduplicated(events_stream(t), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"))


@query("str_streamed_debounce")
def _(t):
    return drain(t, feeds.debounced(events_stream(t), "user_id", "ts", 86400))
