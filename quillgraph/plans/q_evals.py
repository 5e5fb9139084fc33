"""Queries of evaluation, layers of communities, the queue, and the feed, as their rules have them."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import rules as RU
from quillgraph.functions import strings as S
from quillgraph.operators import datasets as DS
from quillgraph.operators import dedup as D
from quillgraph.operators import evals as E
from quillgraph.operators import jobs as J
from quillgraph.operators import provenance as P
from quillgraph.operators.ordered import running
from quillgraph.plans.canonical import query
from quillgraph.plans.q_graph import FRESH, KEPT, _fresh, _kept
from quillgraph.plans.q_jobs import drain, events_stream
from quillgraph.plans.q_rules import NOISE, REGION_KEYS, lit, sql_has, words
from quillgraph.session import checkpoint_dir
from quillgraph.sources import feed
from quillgraph.sources import versions as VS

CHAIN = "article join source using (source_id) join product using (product_id) join vendor using (vendor_id)"
_NOISY = f"select entity_id from {NOISE} where rule <> 'kept'"


# Feed --------------------------------------------------------------------------------------------------------------------


def _lines(t):
    """The feed of each user as NDJSON: blank and malformed lines, tombstones, and for some a cursor at the end."""
    c = F.col("event_type")
    change = F.when(c == "click", "removed").when(c != "signup", "updated")
    control = F.when(c == "signup", "cursor")
    line = F.to_json(F.struct(change.alias("change_type"), control.alias("control"), F.when(c == "signup", F.col("event_id").cast("string")).alias("next_since"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq")))
    return t.events.select("event_id", "user_id", c.alias("op"), F.when(F.col("event_id") % 10 == 0, "  ").when(c == "error", F.concat(F.lit("{"), line)).otherwise(line).alias("line"))


_FED = "l as (select * from events where event_id % 10 <> 0)"


@query("src_1_feed_lines", f"""with {_FED} select user_id, count(*) filter (event_type not in ('error', 'signup')) as applied, count(*) filter (event_type = 'error') as malformed, bool_or(event_type = 'signup') as clean,
    case when bool_or(event_type = 'signup') and count(*) filter (event_type = 'error') = 0 then max(cast(event_id as varchar)) filter (event_type = 'signup') else 'start' end as cursor from l group by user_id""")
def _(t):
    lines = _lines(t).withColumn("old_cursor", F.lit("start"))
    return feed.pulled(feed.parse_records(lines), "user_id")


@query("src_2_record_kinds", f"""with {_FED} select event_type as op, case event_type when 'error' then 'malformed' when 'signup' then 'control' when 'click' then 'tombstone' else 'content' end as record, count(*) as n from l group by all""")
def _(t):
    return feed.parse_records(_lines(t)).groupBy("op", F.col("kind").alias("record")).agg(F.count("*").alias("n"))


@query("src_4_dead_letters", f"with {_FED} select event_id, user_id from l where event_type = 'error'")
def _(t):
    """Malformed lines with where they came from; their feed's cursor stays (src_1_feed_lines)."""
    return feed.parse_records(_lines(t)).filter("kind = 'malformed'").select("event_id", "user_id")


@query("src_13_first_reply_wins", """with j as (select event_id, user_id, json_valid(reply) as ok from label_reply), f as (select user_id, min(event_id) filter (ok) as first, count(*) filter (ok) - 1 as duplicates, count(*) filter (not ok) as unusable from j group by user_id)
    select user_id, first, greatest(duplicates, 0) as duplicates, unusable from f""")
def _(t):
    """Lines that can't be read are counted; of a call's replies the first stands."""
    ok = F.from_json("reply", "labels array<struct<n:int,verdict:string>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    j = t.label_reply.select("event_id", "user_id", (ok.isNotNull() & ok["_bad"].isNull()).alias("ok"))
    return j.groupBy("user_id").agg(F.min(F.when(F.col("ok"), F.col("event_id"))).alias("first"), F.greatest(F.count_if("ok") - 1, F.lit(0)).alias("duplicates"), F.count_if(~F.col("ok")).alias("unusable"))


_KEY = "a secret"
_PADS = ["".join(f"{b ^ x:02X}" for b in _KEY.encode().ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query("src_15_signed_deliveries", f"""with s as (select user_id, event_id, props, case when event_id % 4 = 0 then 'forged' else sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(props)))) end as given from events),
    v as (select *, given = sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(props)))) as ok from s)
    select user_id, count(distinct given) filter (ok) as accepted, count(*) filter (ok) - count(distinct given) filter (ok) as repeated, count(*) filter (not ok) as rejected from v group by user_id""")
def _(t):
    """Deliveries whose signature is that of their body; equal signatures are one delivery."""
    own = S.hmac_sha256(_KEY, F.col("props"))
    v = t.events.select("user_id", F.when(F.col("event_id") % 4 == 0, "forged").otherwise(own).alias("given"), own.alias("own"))
    ok = F.col("given") == F.col("own")
    g = v.groupBy("user_id").agg(F.count_distinct(F.when(ok, F.col("given"))).alias("accepted"), F.count_if(ok).alias("n"), F.count_if(~ok).alias("rejected"))
    return g.select("user_id", "accepted", (F.col("n") - F.col("accepted")).alias("repeated"), "rejected")


@query("src_18_memoised_drafts", f"""with f as ({FRESH}), k as ({KEPT}), c as (select community, string_agg(cast(node as varchar), ',' order by node) as context from (select * from f qualify row_number() over (partition by community order by node) <= 20) group by community),
    o as (select community, string_agg(cast(node as varchar), ',' order by node) as context from (select * from k qualify row_number() over (partition by community order by node) <= 20) group by community)
    select c.community, c.community || ':' || substr(sha1(c.context), 1, 16) as key, exists (select 1 from o where o.community = c.community and o.context = c.context) as saved from c""")
def _(t):
    """A draft is reused if the model would see the same: its key is the community and a hash of the rendered context."""

    def keys(layer):
        first = layer.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy("node"))).filter("rn <= 20")
        context = F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), ",")
        return first.groupBy("community").agg(F.concat(F.col("community"), F.lit(":"), F.substring(F.sha1(context), 1, 16)).alias("key"))

    drafts = VS.Drafts(VS.Store(t.spark, f"{checkpoint_dir(t.spark)}/stores/{uuid.uuid4().hex}"))
    drafts.save(keys(_kept(t)).select("key", F.concat(F.lit("report on "), "key").alias("draft")))
    return drafts.load(keys(_fresh(t))).select("community", "key", F.col("draft").isNotNull().alias("saved"))


@query("str_1_feed_gate", f"""with {_FED} select case when bool_or(event_type = 'signup') and count(*) filter (event_type = 'error') = 0 then 'advance' else 'stay' end as gate, user_id, count(*) filter (event_type not in ('error', 'signup')) as applied from l group by user_id""")
def _(t):
    """The feed as a stream: records are applied, and a user's cursor advances only after a clean end without malformed
    lines. A second pull can't run beside the first: it would need the stream's checkpoint, which one query holds."""
    c = F.col("event_type")
    good, bad, end = F.count_if(~c.isin("error", "signup")), F.count_if(c == "error"), F.bool_or(c == "signup")
    stream = events_stream(t).filter("event_id % 10 <> 0").groupBy("user_id").agg(good.alias("applied"), bad.alias("bad"), end.alias("end"))
    return drain(t, stream, "complete").select(F.when(F.col("end") & (F.col("bad") == 0), "advance").otherwise("stay").alias("gate"), "user_id", "applied")


@query("str_2_resumed_bootstrap", """with a as (select user_id % 20 as source_id, max(event_id) filter (event_type = 'purchase') as last, count(*) filter (event_type = 'purchase') as applied from events group by 1)
    select a.source_id, a.last, count(e.event_id) as remaining, applied // 200 as reports, count(e.event_id) = 0 as done from a left join events e on e.user_id % 20 = a.source_id and e.event_id > a.last group by a.source_id, a.last, applied""")
def _(t):
    """Where a bootstrap that stopped goes on: after the last applied id of its source, with how much is left and how
    often it reported (every 200)."""
    e = t.events.select((F.col("user_id") % 20).alias("source_id"), "event_id", "event_type")
    is_done = F.col("event_type") == "purchase"
    a = e.groupBy("source_id").agg(F.max(F.when(is_done, F.col("event_id"))).alias("last"), F.count_if(is_done).alias("applied"))
    left = e.join(a, "source_id").filter("event_id > last").groupBy("source_id").agg(F.count("*").alias("remaining"))
    n = F.coalesce("remaining", F.lit(0))
    return a.join(left, "source_id", "left").select("source_id", "last", n.alias("remaining"), F.floor(F.col("applied") / 200).alias("reports"), (n == 0).alias("done"))


def _claimed(t):
    return t.job.select("job_id", "article_id", "status", "attempts", F.col("enqueued_at").alias("claimed_at"), F.col("enqueued_at").alias("next_at"))


@query("str_8_complete", "select job_id, case when status = 'in_progress' and job_id % 4 = 0 and job_id % 8 <> 0 then 'done' else status end as status from job")
def _(t):
    """Jobs reported done; every second report has a claim that isn't the job's any more."""
    jobs = _claimed(t)
    hour = F.expr("interval 1 hour")
    done = jobs.filter("job_id % 4 = 0").select("job_id", F.when(F.col("job_id") % 8 == 0, F.col("claimed_at") - hour).otherwise(F.col("claimed_at")).alias("claimed_at"))
    return J.complete(jobs, done).select("job_id", "status")


@query("str_8_defer", """with m as (select *, status = 'in_progress' and job_id % 3 = 0 as mine from job) select job_id, case when mine then 'pending' else status end as status, attempts, mine as deferred from m
    where not (mine and article_id in (select article_id from job where status = 'pending'))""")
def _(t):
    """Jobs deferred without a spent attempt; one whose article has a pending job by now goes."""
    jobs = _claimed(t)
    out = J.defer(jobs, jobs.filter("job_id % 3 = 0").select("job_id", "claimed_at"), F.expr("timestamp_ntz'2024-02-01 00:00:00'"), 600)
    return out.select("job_id", "status", "attempts", (F.col("claimed_at").isNull() & (F.col("status") == "pending")).alias("deferred"))


@query("str_11_metrics", "select lane, status, count(*) as n, round(sum(tokens), 4) as tokens from job group by all")
def _(t):
    """Gauges of a stream in complete mode: each refresh is the whole table, so that label sets that vanish are gone."""
    e = events_stream(t)
    kind = F.col("event_type")
    status = F.when(kind == "error", "dead").when(kind.isin("signup", "purchase"), "done").when(kind == "click", "in_progress").otherwise("pending")
    lane = F.when(F.col("event_id") % 3 == 0, "bootstrap").otherwise("incremental")
    return drain(t, e.groupBy(lane.alias("lane"), status.alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("tokens")), "complete")


@query("str_6_debounce", """with recursive e as (select user_id, epoch(ts)::bigint as at, row_number() over (partition by user_id order by ts, event_id) as rn from events),
    n as (select a.user_id, a.rn, min(b.rn) as nxt from e a left join e b on b.user_id = a.user_id and b.at - a.at > 86400 group by 1, 2),
    p(user_id, rn) as (select user_id, 1::bigint from e group by user_id union all select n.user_id, n.nxt from p join n on n.user_id = p.user_id and n.rn = p.rn where n.nxt is not null) select user_id, count(*)::int as passed from p group by user_id""")
def _(t):
    return J.debounce(t.events, "user_id", "ts", 86400)


# Windows ------------------------------------------------------------------------------------------------------------------


@query("win_3_lead_gap", """with g as (select event_id, epoch(lead(ts) over (order by ts, event_id)) - epoch(ts) as gap from events) select event_id, round(coalesce(gap, avg(gap) over ()), 6) as gap from g""")
def _(t):
    """Time to the next start of any event; the last one gets the mean. The next is a join on places, not one window."""
    at = F.col("ts").cast("timestamp").cast("double")
    r = running(t.events.select("event_id", at.alias("at")), [], [F.col("at"), F.col("event_id")])
    g = r.join(r.select((F.col("place") - 1).alias("place"), F.col("at").alias("next")), "place", "left").select("event_id", (F.col("next") - F.col("at")).alias("gap"))
    return g.join(F.broadcast(g.agg(F.avg("gap").alias("mean")))).select("event_id", F.round(F.coalesce("gap", "mean"), 6).alias("gap"))  # one row


@query("win_7_running_share", "select p_brand, p_partkey, round(sum(p_retailprice) over (partition by p_brand order by p_partkey) / sum(p_retailprice) over (partition by p_brand), 6) as share from part")
def _(t):
    r = running(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.col("p_partkey")], F.col("p_retailprice"))
    return r.select("p_brand", "p_partkey", F.round((F.col("before") + F.col("p_retailprice")) / F.col("total"), 6).alias("share"))


@query("win_12_budget_cut", """with r as (select source, doc_id, n_chars, sum(n_chars + 1) over (partition by source order by doc_id) as used, row_number() over (partition by source order by doc_id) as rn from documents)
    select source, doc_id, least(n_chars, 2000) as shown from r where used <= 2001 or rn = 1""")
def _(t):
    """Lines in order while they fit, and the first one in any case, clipped to the budget."""
    r = running(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars") + 1)
    return r.filter((F.col("before") + F.col("n_chars") + 1 <= 2001) | (F.col("place") == 1)).select("source", "doc_id", F.least("n_chars", F.lit(2000)).alias("shown"))


@query("win_14_vendor_round_robin", """with a as (select source, lang, doc_id, row_number() over (partition by source, lang order by md5(cast(doc_id as varchar)), doc_id) as depth from documents), b as (select *, row_number() over (partition by source order by depth, lang) as turn from a)
    select doc_id, row_number() over (order by turn, source) as place from b""")
def _(t):
    """Vendors (here sources) take turns, and within one its strata (languages) do."""
    d = t.documents.select("source", "lang", "doc_id")
    a = running(d, ["source", "lang"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]).select("source", "lang", "doc_id", F.col("place").alias("depth"))
    b = running(a, ["source"], [F.col("depth"), F.col("lang")]).select("source", "doc_id", F.col("place").alias("turn"))
    return running(b, [], [F.col("turn"), F.col("source")]).select("doc_id", "place")


@query("win_15_early_stop", """with e as (select user_id, event_id as step, value as loss, row_number() over (partition by user_id order by event_id) as rn, count(*) over (partition by user_id) as n, first_value(value) over (partition by user_id order by event_id) as start from events where event_type = 'purchase'),
    b as (select *, bool_or(rn > 1 and loss < start - 100) over (partition by user_id order by rn) as broken from e)
    select user_id, n > 3 and min(loss) filter (rn > n - 3) > min(loss) filter (rn <= n - 3) as stop, min_by(step, (loss, step)) as best, max(step) filter (rn > 1 and not broken) as before_breach from b group by user_id, n""")
def _(t):
    """Stop once the last three evaluations all lie above the best before them; the step with the lowest loss, the earlier
    of equal ones; the last step before the first that falls more than 100 below the start."""
    w = Window.partitionBy("user_id").orderBy("step")
    e = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"))
    e = e.select("*", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("user_id")).alias("n"), F.first("loss").over(w).alias("start"))
    e = e.withColumn("broken", F.max(((F.col("rn") > 1) & (F.col("loss") < F.col("start") - 100)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    recent = F.col("rn") > F.col("n") - 3
    g = e.groupBy("user_id", "n").agg(F.min(F.when(recent, F.col("loss"))).alias("late"), F.min(F.when(~recent, F.col("loss"))).alias("early"), F.min_by("step", F.struct("loss", "step")).alias("best"), F.max(F.when((F.col("rn") > 1) & ~F.col("broken"), F.col("step"))).alias("before_breach"))
    stop = F.when(F.col("n") <= 3, F.lit(False)).otherwise(F.col("late") > F.col("early"))
    return g.select("user_id", stop.alias("stop"), "best", "before_breach")


@query("top_10_dispatch_spread", """with r as (select source_id, article_id, row_number() over (partition by source_id order by sort_order nulls last, article_id) as rn from article)
    select source_id, article_id, row_number() over (partition by source_id order by rn > 2, case when rn <= 2 then rn else article_id end) as turn from r""")
def _(t):
    """A warm-up prefix in the order of contents, the rest by id, so that siblings don't run side by side."""
    r = running(t.article.select("source_id", "article_id", F.coalesce("sort_order", F.lit(1 << 40)).alias("so")), ["source_id"], [F.col("so"), F.col("article_id")]).select("source_id", "article_id", F.col("place").alias("rn"))
    late = F.col("rn") > 2
    return running(r, ["source_id"], [late, F.when(late, F.col("article_id")).otherwise(F.col("rn"))]).select("source_id", "article_id", F.col("place").alias("turn"))


@query("top_13_fair_share", """with s as (select source, doc_id, n_chars, (20000 - coalesce(sum(n_chars) over (partition by source order by n_chars, doc_id rows between unbounded preceding and 1 preceding), 0)) * 1.0 / (count(*) over (partition by source) - row_number() over (partition by source order by n_chars, doc_id) + 1) as level from documents),
    c as (select source, min_by(level, (n_chars, doc_id)) as cut from s where n_chars > level group by source) select source, doc_id as id, round(least(n_chars::double, coalesce(cut, n_chars)), 6) as given from s left join c using (source)""")
def _(t):
    return DS.fair_share(t.documents.select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("size")), "source", 20000).withColumn("given", F.round("given", 6))


@query("win_13_greedy_packing", """with recursive c as (select conv_id, turn, coalesce(length(text), 0) as n, row_number() over (partition by conv_id order by turn) as rn from conversations),
    p(conv_id, rn, used, pack) as (select conv_id, rn, n, 0 from c where rn = 1 union all select c.conv_id, c.rn, case when p.used + c.n > 800 then c.n else p.used + c.n end, case when p.used + c.n > 800 then p.pack + 1 else p.pack end from p join c on c.conv_id = p.conv_id and c.rn = p.rn + 1)
    select p.conv_id, c.turn, p.pack from p join c using (conv_id, rn)""")
def _(t):
    return DS.pack_consecutive(t.conversations, "conv_id", "turn", F.length("text"), 800)


# Evaluation ----------------------------------------------------------------------------------------------------------------


@query("agg_7_latency_buckets", """with b as (select case when n = 1 then '1' when n <= 4 then '2-4' when n <= 9 then '5-9' when n <= 19 then '10-19' else '20+' end as bucket, value from (select 1 + event_id % 30 as n, value from events))
    select bucket, count(*) as n, round(median(value), 6) as med, round(count(*) * 1.0 / sum(count(*)) over (), 6) as share from b group by bucket""")
def _(t):
    n = 1 + F.col("event_id") % 30
    bucket = F.when(n == 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")
    g = t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("med"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("whole")))).select("bucket", "n", "med", F.round(F.col("n") / F.col("whole"), 6).alias("share"))  # one row


_PAIRS = [(["OpenID"], ["R-Studio"]), (["AccountID", "openid"], ["OpenID"]), (["nowhere"], ["OpenID"])]


@query("agg_24_dedup_acceptance", f"""with n as (select lower(name) as key, entity_id from entity_name), x as (select lower(e.name) as key, count(distinct vendor) as vendors from entity_name e join mention using (entity_id) join episode using (episode_id) join {CHAIN} using (article_id) group by 1),
    m as (select 'should_merge' as kind, a.name as name, count(entity_id) as n, case when coalesce(max(vendors), 0) > 1 then 'cross_vendor' else 'one_vendor' end as state from (values ('OpenID'), ('R-Studio'), ('nowhere')) a(name) left join n on n.key = lower(a.name) left join x on x.key = lower(a.name) group by a.name),
    p as (select * from (values {', '.join(f"({lit(a[0])}, {words([x.lower() for x in a])}, {words([x.lower() for x in b])})" for a, b in _PAIRS)}) v(name, a, b)),
    s as (select p.name, (select list(entity_id) from n where list_contains(p.a, key)) as ia, (select list(entity_id) from n where list_contains(p.b, key)) as ib from p)
    select kind, name, n, state from m union all select 'should_distinct', name, coalesce(len(ia), 0), case when ia is null or ib is null then 'absent' when list_has_any(ia, ib) then 'merged' else 'distinct' end from s
    union all select 'suspect', key, vendors, 'vendor_token' from x where vendors > 1 and contains(key, 'aws')""")
def _(t):
    """Names that should be one node, with how many there are; pairs that should differ, by whether their nodes overlap;
    names with a vendor's word that several vendors' texts mention."""
    n = t.entity_name.select(F.lower("name").alias("key"), "entity_id")
    chained = P.chain(t.article, t.source, t.product, t.vendor).select("article_id", "vendor")
    x = n.join(t.mention, "entity_id").join(t.episode.select("episode_id", "article_id"), "episode_id").join(chained, "article_id").groupBy("key").agg(F.count_distinct("vendor").alias("vendors"))
    merge = t.spark.createDataFrame([(a, a.lower()) for a in ("OpenID", "R-Studio", "nowhere")], "name string, key string")
    counts = n.join(F.broadcast(merge.select("key")), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))  # a fixed list
    m = merge.join(counts, "key", "left").join(x, "key", "left").select(F.lit("should_merge").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("vendors", F.lit(0)) > 1, "cross_vendor").otherwise("one_vendor").alias("state"))
    forms = t.spark.createDataFrame([(a[0], side, f.lower()) for a, b in _PAIRS for side, forms in (("a", a), ("b", b)) for f in forms], "name string, side string, key string")
    hit = n.join(F.broadcast(forms), "key").groupBy("name", "entity_id").agg(F.bool_or(F.col("side") == "a").alias("a"), F.bool_or(F.col("side") == "b").alias("b"))
    per = hit.groupBy("name").agg(F.count_if("a").alias("na"), F.count_if("b").alias("nb"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    state = F.when((F.coalesce("na", F.lit(0)) == 0) | (F.coalesce("nb", F.lit(0)) == 0), "absent").when(F.col("both") > 0, "merged").otherwise("distinct")
    s = forms.select("name").distinct().join(per, "name", "left").select(F.lit("should_distinct").alias("kind"), "name", F.coalesce("na", F.lit(0)).alias("n"), state.alias("state"))
    return m.unionByName(s).unionByName(x.filter("vendors > 1 and contains(key, 'aws')").select(F.lit("suspect").alias("kind"), F.col("key").alias("name"), F.col("vendors").alias("n"), F.lit("vendor_token").alias("state")))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"


@query("agg_27_precision_recall", f"""with r as (select source, n_chars % 50 as key, max_by(lang, doc_id) as lang, max_by({_WORDS}, doc_id) as w from documents where doc_id % 3 <> 0 group by all),
    o as (select source, n_chars % 50 as key, max_by(lang, doc_id) as lang, max_by({_WORDS}, doc_id) as w from documents where doc_id % 4 <> 0 group by all),
    j as (select coalesce(r.source, o.source) as source, r.key is not null and o.key is not null as hit, r.key is null as extra, r.lang = o.lang as same, case when r.key = o.key then coalesce(len(list_intersect(r.w, o.w)) * 1.0 / nullif(len(list_distinct(r.w || o.w)), 0), 0) end as jaccard from r full join o on r.source = o.source and r.key = o.key),
    s as (select source, count(*) filter (hit) as tp, count(*) filter (extra) as fp, count(*) filter (not hit and not extra) as fn, count(*) filter (hit and same) as types, sum(jaccard) as jac from j group by source)
    select source, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
      round(coalesce(types / nullif(tp, 0), 0), 6) as type_agree, round(coalesce(jac / nullif(tp, 0), 0), 6) as word_jaccard from s""")
def _(t):
    """Items of a reply against those of a reference, of each prompt (here a source): equal keys are hits; of equal keys in
    one reply the last counts. Types that agree, and the overlap of words, over the hits."""

    def side(rule: str, p: str):
        rows = t.documents.filter(rule).select("source", (F.col("n_chars") % 50).alias("key"), "doc_id", "lang", F.array_distinct(S.tokens(F.coalesce("text", F.lit("")))).alias("w"))
        return rows.groupBy("source", "key").agg(F.max_by(F.struct("lang", "w"), "doc_id").alias(p))

    j = side("doc_id % 3 <> 0", "r").join(side("doc_id % 4 <> 0", "o"), ["source", "key"], "full_outer")
    hit = F.col("r").isNotNull() & F.col("o").isNotNull()
    jac = F.coalesce(F.try_divide(F.size(F.array_intersect("r.w", "o.w")).cast("double"), F.size(F.array_union("r.w", "o.w"))), F.lit(0.0))
    s = j.groupBy("source").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("r").isNull()).alias("fp"), F.count_if(F.col("o").isNull()).alias("fn"), F.count_if(hit & (F.col("r.lang") == F.col("o.lang"))).alias("types"), F.sum(F.when(hit, jac)).alias("jac"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp = F.col("tp").cast("double")
    return s.select("source", "tp", "fp", "fn", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"), share(F.col("types").cast("double"), tp).alias("type_agree"), share(F.col("jac"), tp).alias("word_jaccard"))


@query("agg_28_confusion", """with v as (select case when quality = 0 then 'unsupported' else 'stated' end as ours, case when toxic = 1 or doc_id % 3 = 0 then 'unsupported' else 'stated' end as theirs from labels), m as (select ours, theirs, count(*) as n from v group by all),
    r as (select sum(n) filter (ours = 'unsupported' and theirs = 'unsupported') / nullif(sum(n) filter (ours = 'unsupported'), 0) as recall from m) select ours, theirs, n, round(coalesce(recall, 0), 6) as recall, coalesce(recall, 0) >= 0.9 - 1e-9 as passed from m, r""")
def _(t):
    """Verdicts of one labeller against another's, and whether the second finds nine tenths of what the first rejects."""
    ours = F.when(F.col("quality") == 0, "unsupported").otherwise("stated")
    theirs = F.when((F.col("toxic") == 1) | (F.col("doc_id") % 3 == 0), "unsupported").otherwise("stated")
    m = t.labels.groupBy(ours.alias("ours"), theirs.alias("theirs")).agg(F.count("*").alias("n"))
    bad = F.col("ours") == "unsupported"
    r = m.agg(F.coalesce(F.try_divide(F.sum(F.when(bad & (F.col("theirs") == "unsupported"), F.col("n"))).cast("double"), F.sum(F.when(bad, F.col("n")))), F.lit(0.0)).alias("recall"))
    return m.join(F.broadcast(r)).select("ours", "theirs", "n", F.round("recall", 6).alias("recall"), (F.col("recall") >= 0.9 - 1e-9).alias("passed"))  # one row


_U = "('0x' || substr(md5(rep || ':' || doc_id), 1, 8))::ubigint / 4294967296.0"
_POISSON = []
_total, _term = 0.0, 0.36787944117144233
for _k in range(8):
    _total += _term
    _POISSON.append(f"({_U} > {_total!r})::int")
    _term /= _k + 1


@query("agg_30_bootstrap", f"""with w as (select rep, {' + '.join(_POISSON)} as w, quality, 1 as one from labels, range(1, 201) r(rep)), s as (select rep, sum(w * quality) as o, sum(w * one) as u from w group by rep having sum(w * one) <> 0), r as (select list_sort(list(o / u)) as r from s)
    select round(r[least(len(r) - 1, floor(0.025 * len(r)))::int + 1], 6) as low, round((select avg(quality) from labels), 6) as ratio, round(r[least(len(r) - 1, floor(0.975 * len(r)))::int + 1], 6) as high from r""")
def _(t):
    return E.bootstrap_ratio(t.labels.withColumn("one", F.lit(1)), "quality", "one", "doc_id").select(*[F.round(c, 6).alias(c) for c in ("low", "ratio", "high")])


@query("agg_38_missing_term", """with k as (select size, count(*) as kept from entity group by size), m as (select size, case entity_id % 3 when 0 then 'agent' else 'vault' end as term, count(*) as n, min(entity_id) as first from entity where price > 1000 group by all)
    select size, term, n from m join k using (size) where n >= 2 and 2 * n >= kept qualify row_number() over (partition by size order by n desc, first) = 1""")
def _(t):
    """Of each answer (a size) the term that most items lack alone: two or more, and half of those kept; the first seen of
    equal ones."""
    k = t.entity.groupBy("size").agg(F.count("*").alias("kept"))
    m = t.entity.filter("price > 1000").groupBy("size", F.when(F.col("entity_id") % 3 == 0, "agent").otherwise("vault").alias("term")).agg(F.count("*").alias("n"), F.min("entity_id").alias("first"))
    ok = m.join(k, "size").filter("n >= 2 and 2 * n >= kept")
    return ok.groupBy("size").agg(F.min_by(F.struct("term", "n"), F.struct(-F.col("n"), F.col("first"))).alias("b")).select("size", "b.term", "b.n")


@query("agg_39_adopt_decision", """with p as (select l_orderkey, min(l_returnflag) as grp, sum(l_quantity) filter (l_linenumber % 2 = 1) as a, sum(l_quantity) filter (l_linenumber % 2 = 0) as b, count(*) filter (l_linenumber % 2 = 1) as fa, count(*) filter (l_linenumber % 2 = 0) as fb from lineitem group by l_orderkey)
    select grp, round(median(b / a), 6) as ratio, sum(fa)::bigint as facts_a, sum(fb)::bigint as facts_b, case when median(b / a) <= 1 and sum(fb) >= 0.7 * sum(fa) then 'adopt' else 'keep' end as decision from p where a > 0 and b is not null group by grp""")
def _(t):
    """Two arms over the same articles (orders): adopt the second if its median cost isn't above the first's, and it finds
    seven tenths of the facts or more."""
    odd = F.col("l_linenumber") % 2 == 1
    p = t.lineitem.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("grp"), F.sum(F.when(odd, F.col("l_quantity"))).alias("a"), F.sum(F.when(~odd, F.col("l_quantity"))).alias("b"), F.count_if(odd).alias("fa"), F.count_if(~odd).alias("fb")).filter("a > 0 and b is not null")
    g = p.groupBy("grp").agg(F.median(F.col("b") / F.col("a")).alias("r"), F.sum("fa").alias("facts_a"), F.sum("fb").alias("facts_b"))
    return g.select("grp", F.round("r", 6).alias("ratio"), "facts_a", "facts_b", F.when((F.col("r") <= 1) & (F.col("facts_b") >= 0.7 * F.col("facts_a")), "adopt").otherwise("keep").alias("decision"))


@query("agg_41_crosscheck", f"""with d as (select j.job_id, a.article_id is not null as there, {sql_has('a.title', RU.NAVIGATION)} as nav, a.article_id in (select article_id from episode where chunk_index <= 2 and article_id % 8 <> 0) as has from job j left join page_title a on a.article_id = j.article_id where j.status = 'done'),
    s as (select count(*) as shards, count(*) filter (n = 0) as empty from (select source_id, (select count(*) from article where article.source_id = source.source_id) as n from source)), st as (select count(*) as stranded from article where not removed and article_id not in (select article_id from episode) and article_id not in (select article_id from job))
    select shards, empty, count(*) as done, count(*) filter (not there) as missing, count(*) filter (there and not has and not nav) as no_episode, count(*) filter (there and not has and nav) as navigation, any_value(stranded) as stranded,
      empty = 0 and count(*) filter (not there) = 0 and count(*) filter (there and not has and not nav) = 0 and any_value(stranded) = 0 as ok from d, s, st group by shards, empty""")
def _(t):
    """Shards without articles, done jobs whose article is missing or has no episode (navigation pages need none), and
    articles that nothing covers; all must be none."""
    pages = t.page_title.select("article_id", RU.is_navigation(F.col("title")).alias("nav"), F.lit(True).alias("there"))
    has = t.episode.filter("chunk_index <= 2 and article_id % 8 <> 0").select("article_id", F.lit(True).alias("has")).distinct()
    d = t.job.filter("status = 'done'").select("article_id").join(pages, "article_id", "left").join(has, "article_id", "left").select(*[F.coalesce(c, F.lit(False)).alias(c) for c in ("there", "nav", "has")])
    bare = F.col("there") & ~F.col("has")
    jobs = d.agg(F.count("*").alias("done"), F.count_if(~F.col("there")).alias("missing"), F.count_if(bare & ~F.col("nav")).alias("no_episode"), F.count_if(bare & F.col("nav")).alias("navigation"))
    per = t.source.select("source_id").join(t.article.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left")
    shards = per.agg(F.count("*").alias("shards"), F.count_if(F.col("n").isNull()).alias("empty"))
    bare = t.article.filter(~F.col("removed")).join(t.episode.select("article_id"), "article_id", "left_anti").join(t.job.select("article_id"), "article_id", "left_anti").agg(F.count("*").alias("stranded"))
    ok = (F.col("empty") == 0) & (F.col("missing") == 0) & (F.col("no_episode") == 0) & (F.col("stranded") == 0)
    return jobs.join(F.broadcast(shards)).join(F.broadcast(bare)).withColumn("ok", ok)  # one row each


@query("agg_43_enumeration_hit", """with k as (select label, kind, bool_or(size > 20) as expected, bool_or(price > 1000) as documented, bool_or(size % 2 = 0 or price > 1100) as cited from entity group by all)
    select label, bool_and(expected = documented) and bool_and(not documented or cited) as exact from k group by label""")
def _(t):
    """The documented set equals the expected one, and all of it is cited."""
    k = t.entity.groupBy("label", "kind").agg(F.bool_or(F.col("size") > 20).alias("e"), F.bool_or(F.col("price") > 1000).alias("d"), F.bool_or((F.col("size") % 2 == 0) | (F.col("price") > 1100)).alias("c"))
    return k.groupBy("label").agg((F.bool_and(F.col("e") == F.col("d")) & F.bool_and(~F.col("d") | F.col("c"))).alias("exact"))


@query("agg_44_retrieval_check", """with f as (select source, lang, count(*) filter (n_chars > 3000) as evidence, count(*) filter (quality = 1 and n_chars > 3000) as found, count(*) filter (quality = 1) as expected from documents left join labels using (doc_id) group by all),
    q as (select source, case when length(source) % 2 = 0 then 'enumeration' else 'comparison' end as shape, count(*) as facets, count(*) filter (evidence > 0) as with_evidence, case when sum(expected) > 0 then sum(found) > 0 end as hit, bool_and(lang not in ('en', 'de') or evidence > 0) as wanted from f group by source)
    select source, shape, facets, with_evidence, hit, coalesce(hit, true) and wanted and (shape = 'enumeration' or with_evidence = facets) as pass from q""")
def _(t):
    """A question (a source) passes if an expected article is among the evidence and the wanted facets (en, de) have some;
    other than for enumerations, all facets must."""
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    long, good = F.col("n_chars") > 3000, F.col("quality") == 1
    f = d.groupBy("source", "lang").agg(F.count_if(long).alias("evidence"), F.count_if(good & long).alias("found"), F.count_if(good).alias("expected"))
    q = f.groupBy("source").agg(F.count("*").alias("facets"), F.count_if(F.col("evidence") > 0).alias("with_evidence"), F.sum("found").alias("found"), F.sum("expected").alias("expected"), F.bool_and(~F.col("lang").isin("en", "de") | (F.col("evidence") > 0)).alias("wanted"))
    shape, hit = F.when(F.length("source") % 2 == 0, "enumeration").otherwise("comparison"), F.when(F.col("expected") > 0, F.col("found") > 0)
    ok = F.coalesce(hit, F.lit(True)) & F.col("wanted") & ((shape == "enumeration") | (F.col("with_evidence") == F.col("facets")))
    return q.select("source", shape.alias("shape"), "facets", "with_evidence", hit.alias("hit"), ok.alias("pass"))


@query("agg_45_arm_summary", """select lane, count(*) as n, round(median(tokens), 6) as med, round(sum(tokens) * 0.002, 6) as cost, round(sum(tokens) * 0.002 / nullif(count(*) filter (status = 'done'), 0), 6) as per_done, round(sum(tokens) * 2 / nullif(sum(attempts), 0), 6) as per_thousand,
    count(*) filter (attempts = 0) || ',' || count(*) filter (attempts = 1) || ',' || count(*) filter (attempts = 2) || ',' || count(*) filter (attempts >= 3) as tiers from job group by lane""")
def _(t):
    """Totals of each arm (a lane): median, cost, cost for each article done and for a thousand facts, a histogram."""
    cost, a = F.sum("tokens") * 0.002, F.col("attempts")
    tiers = F.concat_ws(",", *[F.count_if(c).cast("string") for c in (a == 0, a == 1, a == 2, a >= 3)])
    return t.job.groupBy("lane").agg(
        F.count("*").alias("n"), F.round(F.median("tokens"), 6).alias("med"), F.round(cost, 6).alias("cost"), F.round(F.try_divide(cost, F.count_if(F.col("status") == "done")), 6).alias("per_done"),
        F.round(F.try_divide(F.sum("tokens") * 2, F.sum("attempts")), 6).alias("per_thousand"), tiers.alias("tiers"),
    )


@query("agg_35_duplicate_risk", """with h as (select md5(text) as h, count(*) as k, min(doc_id) as first from documents group by 1 having count(*) > 1), g as (select first, cast(sum(k - 1) as bigint) as w from h group by first)
    select first, w, round(sum(w) over (order by first) / sum(w) over (), 6) as share from g""")
def _(t):
    g = t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("k"), F.min("doc_id").alias("first")).filter("k > 1").groupBy("first").agg(F.sum(F.col("k") - 1).alias("w"))
    return running(g, [], [F.col("first")], F.col("w")).select("first", "w", F.round((F.col("before") + F.col("w")) / F.col("total"), 6).alias("share"))


# Graph ---------------------------------------------------------------------------------------------------------------------


@query("join_8_siblings", """with g as (select src, relation, count(*) as n from fact where score > 20000 group by all), top as (select src, relation, row_number() over (order by n desc, src, relation) as rank from g qualify rank <= 6),
    s as (select rank, src, relation, fact_id from fact join top using (src, relation) qualify row_number() over (partition by src, relation order by fact_id) <= 20)
    select src, relation, fact_id from s qualify row_number() over (order by rank, fact_id) <= 50""")
def _(t):
    """Facts of the six (subject, relation) groups that the seeds name most: the 20 first of each, 50 in all."""
    seeds = t.fact.filter("score > 20000").groupBy("src", "relation").agg(F.count("*").alias("n"))
    top = seeds.orderBy(F.desc("n"), "src", "relation").limit(6).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "src", "relation"))).drop("n")
    w = Window.partitionBy("src", "relation").orderBy("fact_id")
    s = t.fact.select("src", "relation", "fact_id").join(F.broadcast(top), ["src", "relation"]).withColumn("rn", F.row_number().over(w)).filter("rn <= 20")  # six rows
    return s.orderBy("rank", "fact_id").limit(50).select("src", "relation", "fact_id")


_BEST = f"""f as ({FRESH}), k as ({KEPT}), b as (select f.community as c, k.community as d, count(*) as n from f join k using (node) group by all),
    j as (select c, d, n * 1.0 / ((select count(*) from f where community = c) + (select count(*) from k where community = d) - n) as j from b),
    best as (select c, d from j where j >= 0.5 qualify row_number() over (partition by c order by j desc, d) = 1), size as (select community as d, count(*) as n from k group by 1)"""
_TOUCHED = "bool_or(node in (select src from fact where valid_at > timestamp '2001-07-30'))"


def _matched(t):
    """community, d, n of the persisted community that a fresh one matches best, with how many members that has."""
    from quillgraph.operators import graphs as G

    best = G.jaccard_pairs(_fresh(t), _kept(t), 0.5).groupBy(F.col("fresh").alias("community")).agg(F.min_by("kept", F.struct(-F.col("jaccard"), F.col("kept"))).alias("d"))
    return best.join(_kept(t).groupBy(F.col("community").alias("d")).agg(F.count("*").alias("n")), "d")


def _touched(t):
    from quillgraph.plans.canonical import now

    new = t.fact.filter(F.col("valid_at") > now("2001-07-30")).select(F.col("src").alias("node"), F.lit(True).alias("new")).distinct()
    return _fresh(t).join(new, "node", "left").groupBy("community").agg(F.coalesce(F.bool_or("new"), F.lit(False)).alias("touched"))


@query("gr_4_dirty_communities", f"""with {_BEST}, u as (select community, {_TOUCHED} as touched from f group by community)
    select community, case when d is null then 'unmatched' when touched then 'touched' when n % 5 = 0 then 'unverified' when n % 7 = 0 then 'no_embedding' when n % 3 = 0 then 'stale' else 'clean' end as state from u left join best on c = community left join size using (d)""")
def _(t):
    """Clean is a matched community without touched members whose report was verified, has an embedding and isn't stale
    (made up of the number of members); all others are written anew."""
    x = _touched(t).join(_matched(t), "community", "left")
    state = F.when(F.col("d").isNull(), "unmatched").when(F.col("touched"), "touched").when(F.col("n") % 5 == 0, "unverified").when(F.col("n") % 7 == 0, "no_embedding").when(F.col("n") % 3 == 0, "stale").otherwise("clean")
    return x.select("community", state.alias("state"))


@query("join_31_report_carry_over", f"""with {_BEST}, u as (select community, count(*) as m from f group by community)
    select community, case when d is not null and n % 4 = 0 then 'staged' when m % 3 = 0 and d is not null then 'stale' when m % 3 = 0 then 'lost' when d is not null and m % 2 = 0 then 'carried' else 'written' end as state,
      case when d is not null and (n % 4 = 0 or m % 3 = 0 or m % 2 = 0) then d end as report from u left join best on c = community left join size using (d)""")
def _(t):
    """A staged report stays staged; where writing anew failed the persisted report is kept as stale, or lost without one;
    clean communities carry theirs over. (Failed, clean and staged follow from numbers of members.)"""
    x = _fresh(t).groupBy("community").agg(F.count("*").alias("m")).join(_matched(t), "community", "left")
    has, failed, clean, staged = F.col("d").isNotNull(), F.col("m") % 3 == 0, F.col("m") % 2 == 0, F.coalesce(F.col("n") % 4 == 0, F.lit(False))
    state = F.when(staged, "staged").when(failed & has, "stale").when(failed, "lost").when(clean & has, "carried").otherwise("written")
    return x.select("community", state.alias("state"), F.when(has & (staged | failed | clean), F.col("d")).alias("report"))


_PLAN = "p as (select entity_id, label, min(entity_id) over (partition by name) as s, count(*) over (partition by name) as n from entity_name)"


def _merge(t):
    return D.merge_plan(t.entity_name, "name", [])


@query("gr_6_merge_rewire", f"with {_PLAN} select fact_id, coalesce(a.s, src) as src, coalesce(b.s, dst) as dst from fact left join p a on a.entity_id = src left join p b on b.entity_id = dst")
def _(t):
    """Facts with both ends at the survivors of names that are equal byte for byte; parallels and loops stay."""
    return D.remap(t.fact.select("fact_id", "src", "dst"), _merge(t), ["src", "dst"])


@query("gr_6_merge_audit", f"""with {_PLAN}, g as (select s, count(*) - 1 as losers, count(distinct label) as labels, min(label) as one, any_value(label) filter (entity_id = s) as own from p where n > 1 group by s),
    r as (select fact_id, src, dst, coalesce(a.s, src) as ns, coalesce(b.s, dst) as nd from fact left join p a on a.entity_id = src left join p b on b.entity_id = dst),
    e as (select ns as s from r where src <> ns union all select nd from r where dst <> nd), l as (select ns as s, count(*) as loops from r where ns = nd and src <> dst group by ns),
    m as (select p.s, count(*) as mentions, count(distinct episode_id) as kept from mention join p using (entity_id) where n > 1 group by p.s)
    select g.s as survivor, losers, (select count(*) from e where e.s = g.s) as ends_moved, coalesce(loops, 0) as loops, coalesce(mentions, 0) as mentions, coalesce(kept, 0) as mentions_kept, case when labels = 1 then one end as label, labels > 1 as labels_differ from g left join l using (s) left join m using (s)""")
def _(t):
    """What a merge does to each survivor: losers, fact ends moved, loops made, mentions (a set: one for each episode), and
    the label that all copies agree on."""
    plan = D.merge_plan(t.entity_name, "name", [])
    g = plan.join(t.entity_name.select("entity_id", "label"), "entity_id").groupBy("survivor").agg((F.count("*") - 1).alias("losers"), F.count_distinct("label").alias("labels"), F.min("label").alias("one"))
    # Each fact keeps its ends beside the new ones: two facts may share an id.
    r = D.remap(t.fact.select("src", "dst", F.col("src").alias("s0"), F.col("dst").alias("d0")), plan, ["src", "dst"])
    ends = r.filter("src <> s0").select(F.col("src").alias("survivor")).unionByName(r.filter("dst <> d0").select(F.col("dst").alias("survivor"))).groupBy("survivor").agg(F.count("*").alias("ends_moved"))
    loops = r.filter("src = dst and s0 <> d0").groupBy(F.col("src").alias("survivor")).agg(F.count("*").alias("loops"))
    m = t.mention.join(plan, "entity_id").groupBy("survivor", "episode_id").agg(F.count("*").alias("c")).groupBy("survivor").agg(F.sum("c").alias("mentions"), F.count("*").alias("mentions_kept"))
    out = g.join(ends, "survivor", "left").join(loops, "survivor", "left").join(m, "survivor", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("survivor", "losers", zero("ends_moved"), zero("loops"), zero("mentions"), zero("mentions_kept"), F.when(F.col("labels") == 1, F.col("one")).alias("label"), (F.col("labels") > 1).alias("labels_differ"))


@query("gr_9_retype_guard", f"""with {REGION_KEYS}, x as (select entity_id, label, starts_with(label, 'Brand#1') as was, key in (select key from gazetteer) as is_r from entity_name join k using (entity_id)), c as (select count(*) filter (was) as now, count(*) filter (was and not is_r) as gone from x)
    select entity_id, case when is_r then 'Region' when was and gone <= greatest(2, ceil(0.5 * now)) then 'Entity' when was then 'Region' else label end as label, case when is_r then 'Region' when was then 'Entity' else label end as forced from x, c""")
def _(t):
    """Names of the gazetteer become regions, others that are called one lose the label: unless too many would at once
    (a sign of a broken gazetteer), or it is forced."""
    known = t.gazetteer.select("key", F.lit(True).alias("known"))
    x = t.entity_name.withColumn("key", RU.region_key(F.col("name"))).join(known, "key", "left").select("entity_id", "label", F.col("label").startswith("Brand#1").alias("was"), F.col("known").isNotNull().alias("is_r"))
    c = x.agg(F.count_if("was").alias("now"), F.count_if(F.col("was") & ~F.col("is_r")).alias("gone"))
    fits = F.col("gone") <= F.greatest(F.lit(2), F.ceil(0.5 * F.col("now")))
    label = F.when(F.col("is_r"), "Region").when(F.col("was") & fits, "Entity").when(F.col("was"), "Region").otherwise(F.col("label"))
    return x.join(F.broadcast(c)).select("entity_id", label.alias("label"), F.when(F.col("is_r"), "Region").when(F.col("was"), "Entity").otherwise(F.col("label")).alias("forced"))  # one row


@query("gr_10_prune_noise", f"with bad as ({_NOISY}) select fact_id from fact where src not in (select entity_id from bad) and dst not in (select entity_id from bad)")
def _(t):
    bad = t.entity_name.filter(RU.noise(F.col("name")).isNotNull()).select("entity_id")
    return t.fact.join(bad.withColumnRenamed("entity_id", "src"), "src", "left_anti").join(bad.withColumnRenamed("entity_id", "dst"), "dst", "left_anti").select("fact_id")


@query("gr_10_prune_counts", f"""with bad as ({_NOISY}) select 'entity' as what, count(*) as before, count(*) filter (entity_id not in (select entity_id from bad)) as after from entity_name
    union all select 'mention', count(*), count(*) filter (entity_id not in (select entity_id from bad)) from mention union all select 'fact', count(*), count(*) filter (src not in (select entity_id from bad) and dst not in (select entity_id from bad)) from fact""")
def _(t):
    """An entity goes with all its mentions and facts."""
    bad = t.entity_name.filter(RU.noise(F.col("name")).isNotNull()).select("entity_id", F.lit(1).alias("bad"))
    flag = lambda df, c: df.join(bad.withColumnsRenamed({"entity_id": c, "bad": f"bad_{c}"}), c, "left")
    count = lambda df, what, ok: df.agg(F.count("*").alias("before"), F.count_if(ok).alias("after")).select(F.lit(what).alias("what"), "before", "after")
    ok = F.col("bad_entity_id").isNull()
    out = count(flag(t.entity_name.select("entity_id"), "entity_id"), "entity", ok).unionByName(count(flag(t.mention, "entity_id"), "mention", ok))
    return out.unionByName(count(flag(flag(t.fact.select("src", "dst"), "src"), "dst"), "fact", F.col("bad_src").isNull() & F.col("bad_dst").isNull()))


@query("gr_13_supersede", """with new as (select article_id, unnest([1, 2]) as chunk_index from article where article_id % 3 = 0),
    o as (select e.episode_id, e.superseded or n.article_id is not null or (e.article_id % 3 = 0 and e.chunk_index > 2) as superseded, case when e.died_at is not null then 'before' when n.article_id is not null or (e.article_id % 3 = 0 and e.chunk_index > 2) then 'now' end as died from episode e left join new n using (article_id, chunk_index))
    select * from o union all select 1000000000 + article_id * 10 + chunk_index, false, null from new""")
def _(t):
    """Articles that came again with two chunks: a new link flags the old one of the same place, and places beyond the new
    end are flagged too. An episode dies once: a date that is there stays."""
    again = t.article.filter("article_id % 3 = 0").select("article_id", F.lit(True).alias("again"))
    new = again.select("article_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk_index"))
    e = t.episode.join(again, "article_id", "left")
    hit = F.col("again").isNotNull()  # places 1 and 2 are replaced, later ones fall off
    old = e.select("episode_id", (F.col("superseded") | hit).alias("superseded"), F.when(F.col("died_at").isNotNull(), "before").when(hit, "now").alias("died"))
    return old.unionByName(new.select((F.col("article_id") * 10 + F.col("chunk_index") + 1000000000).alias("episode_id"), F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("died")))


_LAYERS = "select 0 as level, p_brand as community, substr(p_brand, 1, 7) as parent, p_partkey as node from part union all select 1, substr(p_brand, 1, 7), null, p_partkey from part"


@query("gr_14_layer_rewrite", f"""with l as ({_LAYERS}), c as (select level, community, max(parent) as parent, count(*) as n from l group by all), s as (select *, case n % 4 when 0 then 'staged' when 1 then 'lost' when 2 then 'preserved' else 'written' end as state from c),
    k as (select a.level, count(*) as links from s a join s b on b.level = a.level + 1 and b.community = a.parent and a.state <> 'lost' and b.state <> 'lost' group by a.level)
    select level, count(*) filter (state = 'written') as written, count(*) filter (state = 'staged') as staged, count(*) filter (state = 'preserved') as preserved, count(*) filter (state = 'lost') as lost, coalesce(max(links), 0) as links from s left join k using (level) group by level""")
def _(t):
    """The layer that replaces the one before: written, staged (without an embedding), preserved (stale) and lost
    communities of each level; a parent is linked only if both are there."""
    low = t.part.select(F.lit(0).alias("level"), F.col("p_brand").alias("community"), F.substring("p_brand", 1, 7).alias("parent"))
    layers = low.unionByName(low.select(F.lit(1).alias("level"), F.col("parent").alias("community"), F.lit(None).cast("string").alias("parent")))
    state = F.get(F.array(*map(F.lit, ("staged", "lost", "preserved", "written"))), (F.col("n") % 4).cast("int"))
    s = layers.groupBy("level", "community").agg(F.max("parent").alias("parent"), F.count("*").alias("n")).withColumn("state", state)
    there = s.filter("state <> 'lost'")
    up = there.select((F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    links = there.join(up, ["level", "parent"]).groupBy("level").agg(F.count("*").alias("links"))
    counts = s.groupBy("level").agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("written", "staged", "preserved", "lost")])
    return counts.join(links, "level", "left").select("level", "written", "staged", "preserved", "lost", F.coalesce("links", F.lit(0)).alias("links"))


@query("gr_16_semantic_reset", "select * from (select 'article' as what, count(*) as before, count(*) as after from article union all select 'source', count(*), count(*) from source union all select 'episode', count(*), 0 from episode union all select 'fact', count(*), 0 from fact union all select 'mention', count(*), 0 from mention)")
def _(t):
    """The semantic tables are empty after a swap, with their schemas; the structure stays."""
    store = VS.Store(t.spark, f"{checkpoint_dir(t.spark)}/stores/{uuid.uuid4().hex}")
    key = {"article": "article_id", "source": "source_id", "episode": "episode_id", "fact": "fact_id", "mention": "episode_id"}
    before = store.commit(store.snapshot(), {name: getattr(t, name).select(c) for name, c in key.items()})
    after = VS.reset(store, ["episode", "fact", "mention"])
    count = lambda name, at, c: store.read(name, at).agg(F.count("*").alias(c))
    out = [count(n, before, "before").join(F.broadcast(count(n, after, "after"))).select(F.lit(n).alias("what"), "before", "after") for n in key]  # one row each
    return functools.reduce(DataFrame.unionByName, out)


# Datasets ------------------------------------------------------------------------------------------------------------------

_PAIR = "select l_orderkey * 10 + l_linenumber as id, case l_returnflag when 'N' then 'B' when 'R' then 'C' else 'A' end as kind, case l_returnflag when 'A' then -1 when 'R' then 1 + l_linenumber % 3 else 1 end as delta from lineitem where l_linenumber = 1 or l_returnflag <> 'A'"


@query("ds_8_balanced_pairs", f"""with p as ({_PAIR}), t as (select coalesce(sum(delta) filter (kind = 'A'), 0) + coalesce(sum(delta) filter (kind = 'C'), 0) as s, count(*) filter (kind in ('A', 'C')) as n, count(*) filter (kind = 'C') as nc, count(*) filter (kind = 'B') as nb from p),
    o as (select *, row_number() over w as place, sum(delta) over w as upto from p where kind <> 'A' window w as (partition by kind order by sha256(kind || ':seed:' || id) desc rows unbounded preceding)),
    d as (select case when s * 1.0 / n <= 0.25 then 0 else coalesce((select min(place) from o where kind = 'C' and (n - place = 0 or (s - upto) * 1.0 / (n - place) <= 0.25)), nc) end as k from t),
    u as (select s - coalesce((select sum(delta) from o, d where kind = 'C' and place <= k), 0) as s, n - (select k from d) as n, nb from t),
    a as (select case when s * 1.0 / nullif(n, 0) >= 0 then 0 else coalesce((select min(place) from o where kind = 'B' and (s + upto) * 1.0 / (n + place) >= 0), nb) end as j from u),
    r as (select id, kind, delta from p where kind = 'A' union all select id, kind, delta from o, d where kind = 'C' and place > k union all select id, kind, delta from o, a where kind = 'B' and place <= j)
    select id, kind, abs(avg(delta) over ()) <= 0.25 as ok from r""")
def _(t):
    return DS.balance(t.spark.sql(_PAIR.replace("from lineitem", "from {x}"), x=t.lineitem), "seed")


@query("ds_9_lexical_overlap", """with q as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark), d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents)
    select item_id, doc_id, round(len(list_intersect(q.w, d.w)) * 1.0 / len(q.w), 6) as overlap from q, d where len(q.w) > 0 and len(list_intersect(q.w, d.w)) * 1.0 / len(q.w) >= 0.3 - 1e-9""")
def _(t):
    return DS.lexical_overlap(t.benchmark, t.documents, 0.3).withColumn("overlap", F.round("overlap", 6))


@query("ds_9_threshold_sweep", """with a as (select conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as w from conversations),
    p as (select b.conv_id, b.turn, b.turn % 3 = 0 as bad, len(b.w) > 0 as worded, len(list_intersect(b.w, a.w)) * 1.0 / nullif(len(b.w), 0) as share from a b join a on a.conv_id = b.conv_id and a.turn = b.turn - 1),
    g as (select i / 20.0 as t, count(*) filter (bad and worded and share < i / 20.0) * 1.0 / nullif(count(*) filter (bad), 0) as caught, count(*) filter (not bad and worded and share < i / 20.0) * 1.0 / nullif(count(*) filter (not bad), 0) as wrong from p, range(0, 21) r(i) group by i)
    select round(t, 2) as threshold, round(coalesce(caught, 0), 6) as caught, round(coalesce(wrong, 0), 6) as wrong from g where coalesce(wrong, 0) <= 0.5 order by caught desc, t limit 1""")
def _(t):
    """A fact is dropped if too few of its words stand in the message before it: the threshold that catches most of the
    bad ones while at most half of the good ones go."""
    a = t.conversations.select("conv_id", "turn", F.array_distinct(S.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    p = a.join(a.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    p = p.select((F.col("turn") % 3 == 0).alias("bad"), (F.size("w") > 0).alias("some"), F.try_divide(F.size(F.array_intersect("w", "v")).cast("double"), F.size("w")).alias("share"))
    grid = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")).withColumn("gone", F.col("some") & (F.col("share") < F.col("i") / 20.0))
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c & F.col("gone")).cast("double"), F.count_if(c)), F.lit(0.0))
    g = grid.groupBy("i").agg(rate(F.col("bad")).alias("caught"), rate(~F.col("bad")).alias("wrong")).filter("wrong <= 0.5")
    return g.orderBy(F.desc("caught"), "i").limit(1).select(F.round(F.col("i") / 20.0, 2).alias("threshold"), F.round("caught", 6).alias("caught"), F.round("wrong", 6).alias("wrong"))


@query("ds_11_triple_scores", """with p as (select distinct created % 100 as g, src, relation, dst from fact where relation <> 'R'), k as (select distinct created % 100 as g, src, relation, dst from fact where score > 30000),
    s as (select coalesce(p.g, k.g) as g, count(*) filter (p.g = k.g) as hits, count(*) filter (k.g is null) as spurious, count(*) filter (p.g is null) as missed from p full join k on p.g = k.g and p.src = k.src and p.relation = k.relation and p.dst = k.dst group by 1)
    select g, hits, spurious, missed, spurious <= 3 * hits and hits * 2 >= missed as passed from s""")
def _(t):
    """Triples of a reply against those wanted, and a gate on what is spurious and what is missed."""
    key = [(F.col("created") % 100).alias("g"), "src", "relation", "dst"]
    p = t.fact.filter("relation <> 'R'").select(*key).distinct().withColumn("p", F.lit(1))
    k = t.fact.filter("score > 30000").select(*key).distinct().withColumn("k", F.lit(1))
    s = p.join(k, ["g", "src", "relation", "dst"], "full_outer").groupBy("g").agg(F.count_if(F.col("p").isNotNull() & F.col("k").isNotNull()).alias("hits"), F.count_if(F.col("k").isNull()).alias("spurious"), F.count_if(F.col("p").isNull()).alias("missed"))
    return s.withColumn("passed", (F.col("spurious") <= 3 * F.col("hits")) & (F.col("hits") * 2 >= F.col("missed")))


# Scalars -------------------------------------------------------------------------------------------------------------------


@query("txt_math", """select event_id, greatest(4000, least(32000, (event_id % 900) * 80)) as budget, round(value * 0.003 + user_id * 0.015, 6) as cost, round((value - user_id) * 100.0 / nullif(user_id, 0), 4) as delta from events""")
def _(t):
    budget = F.greatest(F.lit(4000), F.least(F.lit(32000), (F.col("event_id") % 900) * 80))
    delta = F.try_divide((F.col("value") - F.col("user_id")) * 100.0, F.col("user_id"))
    return t.events.select("event_id", budget.cast("long").alias("budget"), F.round(F.col("value") * 0.003 + F.col("user_id") * 0.015, 6).alias("cost"), F.round(delta, 4).alias("delta"))


_ISO = "case event_id % 6 when 0 then '2024-01-05T10:00:00Z' when 1 then '2024-01-05' when 2 then '2024-13-01' when 3 then 'soon' when 4 then '2024-02-03 04:05' else null end"


@query("txt_iso_time", f"with x as (select event_id, {_ISO} as s from events) select event_id, case when regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?Z?)?$') then strftime(try_cast(case when length(s) = 16 then s || ':00' else replace(replace(s, 'Z', ''), 'T', ' ') end as timestamp), '%Y%m%d%H%M%S') end as at from x")
def _(t):
    return t.events.select("event_id", F.date_format(S.iso_time(F.expr(_ISO)), "yyyyMMddHHmmss").alias("at"))


@query("txt_json_object", """select event_id, json_extract_string(regexp_extract('Sure: ' || props || ' - done.', '(?s)(\\{.*\\})', 1), '$.k')::bigint as k from events""")
def _(t):
    found = S.json_object(F.concat(F.lit("Sure: "), "props", F.lit(" - done.")))
    return t.events.select("event_id", F.from_json(found, "k bigint")["k"].alias("k"))


@query("txt_common_suffix", """with p as (select p_partkey, p_name as a, p_brand || right(p_name, p_partkey % 9) as b from part), n as (select *, coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: right(a, i) = right(b, i))), 0) as n from p) select p_partkey, right(a, n) as suffix from n""")
def _(t):
    b = F.concat("p_brand", F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.right("p_name", (F.col("p_partkey") % 9).cast("int"))))
    return t.part.select("p_partkey", S.common_suffix(F.col("p_name"), b).alias("suffix"))
