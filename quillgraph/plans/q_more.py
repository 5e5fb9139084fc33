"""Further queries: feed edges, admission rules, alias resolution, evaluation rollups, routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators import ann
from quillgraph.operators import datasets as DS
from quillgraph.operators import evidence as EV
from quillgraph.operators import provenance as P
from quillgraph.operators import scope as SC
from quillgraph.plans.canonical import query
from quillgraph.plans.q_retrieval import COS, query_vector, vectors
from quillgraph.sources import feed

CHAIN = "article join source using (source_id) join product using (product_id) join vendor using (vendor_id)"


def _chain(t):
    return P.chain(t.article, t.source, t.product, t.vendor)


@query("src_16_json_documents", "select doc_id, lang, n_chars from documents")
def _(t):
    packed = t.documents.select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("j"))
    return packed.select(F.from_json("j", "doc_id bigint, lang string, n_chars bigint").alias("d")).select("d.*")


@query("flt_16_conversation_shape", """select conv_id, (min(turn) = 0 and count(distinct turn) = count(*) and max(turn) = count(*) - 1 and bool_and(text is not null)) as valid from conversations group by conv_id""")
def _(t):
    ok = (F.min("turn") == 0) & (F.count_distinct("turn") == F.count("*")) & (F.max("turn") == F.count("*") - 1) & F.bool_and(F.col("text").isNotNull())
    return t.conversations.groupBy("conv_id").agg(ok.alias("valid"))


@query("flt_19_index_range", "select p_partkey, len(list_filter([p_size, p_size - 20, p_size + 15], lambda i: i between 0 and 49)) as known, len(list_filter([p_size, p_size - 20, p_size + 15], lambda i: i > 49 or i < 0)) as stray from part")
def _(t):
    i = F.array("p_size", F.col("p_size") - 20, F.col("p_size") + 15)
    return t.part.select("p_partkey", F.size(F.filter(i, lambda x: x.between(0, 49))).cast("long").alias("known"), F.size(F.filter(i, lambda x: (x > 49) | (x < 0))).cast("long").alias("stray"))


@query("flt_23_map_differences", """with a as (select lang as k, count(*) as v from documents group by lang), b as (select lang as k, count(*) as v from documents where n_chars > 1 group by lang) select coalesce(a.k, b.k) as key, a.v as expected, b.v as actual from a full outer join b on a.k = b.k where a.v is distinct from b.v or a.k < 'z'""")
def _(t):
    a = t.documents.groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("expected"))
    b = t.documents.filter("n_chars > 1").groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("actual"))
    return a.join(b, "key", "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")) | (F.col("key") < "z")).select("key", "expected", "actual")


@query("flt_25_distinctive_names", rf"""select source_id, contains(lower(name), lower(vendor)) and len(list_filter(regexp_extract_all(replace(lower(name), lower(vendor), ' '), '[\w&+.-]+'), lambda w: not list_contains({SC.GENERIC}, w))) > 0 as distinctive from docset""")
def _(t):
    """Document sets whose name holds the vendor's and something beyond it that isn't generic."""
    return t.docset.select("source_id", SC.distinctive(F.col("name"), F.col("vendor")).alias("distinctive"))


@query("prj_2_lean_projection", "select fact_id, src, dst from fact")
def _(t):
    return t.fact.select("fact_id", "src", "dst")


@query("join_14_cell_search")
def _(t):
    """Approximate, by a stored index of every row; its recall is measured in the tests."""
    index = ann.kept_index(t.embeddings, f"vectors of {t.sf_dir}", group_col="label")
    return ann.search(index, t.embeddings.filter("vec_id % 20 = 0"), 10)


@query("join_14_in_group", f"""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id = 0), s as (select query_id, vec_id as id, label, {COS.format(a='embedding', b='q')} as score from embeddings, q where vec_id <> query_id)
    select query_id, id, round(score, 6) as score, row_number() over (order by score desc, id) as rank from s where label = 1 qualify rank <= 5""")
def _(t):
    """The nearest of one group, for a question that its own group is not asked for: a group that the index's candidates
    have too little of is searched exactly."""
    index = ann.kept_index(t.embeddings, f"vectors of {t.sf_dir}", group_col="label")
    found = ann.search(index, t.embeddings.filter("vec_id = 0"), 5, group="1", oversample=1)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("join_17_chunks_with_documents", "select episode_id, title, source from episode join article using (article_id) join source using (source_id) where tokens >= 30")
def _(t):
    return t.episode.filter("tokens >= 30").select("episode_id", "article_id").join(t.article.select("article_id", "title", "source_id"), "article_id").join(t.source.select("source_id", "source"), "source_id").select("episode_id", "title", "source")


@query("join_27_anonymous_pairs", """with l as (select user_id, event_type as side, value from events where event_type in ('view', 'click') qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1),
    p as (select a.user_id, a.value as v, b.value as c, substr(sha256(cast(a.user_id as varchar)), 1, 1) < '8' as coin from l a join l b on a.user_id = b.user_id and a.side = 'view' and b.side = 'click')
    select user_id, case when coin then v else c end as a, case when coin then c else v end as b from p""")
def _(t):
    last = t.events.filter("event_type in ('view', 'click')").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    v = last.filter("event_type = 'view'").select("user_id", F.col("value").alias("v"))
    c = last.filter("event_type = 'click'").select("user_id", F.col("value").alias("c"))
    coin = F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 1) < "8"
    return v.join(c, "user_id").select("user_id", F.when(coin, F.col("v")).otherwise(F.col("c")).alias("a"), F.when(coin, F.col("c")).otherwise(F.col("v")).alias("b"))


@query("agg_25_provenance_rate", f"""with s as (select distinct fact_id from fact_episode join episode using (episode_id) join {CHAIN} using (article_id)) select relation, round(avg((s.fact_id is not null)::int), 6) as rate, count(*) as n from fact f left join s on s.fact_id = f.fact_id group by relation""")
def _(t):
    s = P.fact_sources(t.fact_episode, t.episode, _chain(t)).select("fact_id").distinct().withColumn("there", F.lit(1))
    return t.fact.join(s, "fact_id", "left").groupBy("relation").agg(F.round(F.avg(F.coalesce("there", F.lit(0))), 6).alias("rate"), F.count("*").alias("n"))


@query("agg_26_in_scope_share", f"""with c as (select src, fact_id, coalesce(bool_or(vendor in ('ASIA', 'EUROPE')), false) as inside from fact left join fact_episode using (fact_id) left join episode using (episode_id) left join ({CHAIN}) using (article_id) group by src, fact_id)
    select src, round(avg(inside::int), 6) as share from c group by src having avg(inside::int) >= 0.5""".replace(f"left join ({CHAIN})", f"left join (select article_id, vendor from {CHAIN}) ch"))
def _(t):
    inside = F.max(F.col("vendor").isin("ASIA", "EUROPE").cast("int"))
    s = P.fact_sources(t.fact_episode, t.episode, _chain(t)).groupBy("fact_id").agg(inside.alias("inside"))
    c = t.fact.select("src", "fact_id").join(s, "fact_id", "left").groupBy("src").agg(F.avg(F.coalesce("inside", F.lit(0))).alias("share"))
    return c.filter("share >= 0.5").select("src", F.round("share", 6).alias("share"))


@query("agg_36_counters_merge", "select lane, cast(sum(attempts) as bigint) as attempts, count(*) filter (status = 'dead') as dead, count(*) filter (status = 'done') as done from job group by lane")
def _(t):
    return t.job.groupBy("lane").agg(F.sum("attempts").alias("attempts"), F.count_if(F.col("status") == "dead").alias("dead"), F.count_if(F.col("status") == "done").alias("done"))


@query("agg_37_run_summary", "select role, count(*) as turns, count(*) filter (text is null or length(text) < 20) as refusals, count(*) filter (length(text) >= 20) as ok from conversations group by role")
def _(t):
    n = F.length("text")
    return t.conversations.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.col("text").isNull() | (n < 20)).alias("refusals"), F.count_if(n >= 20).alias("ok"))


@query("agg_42_facet_coverage", f"""with f as (select distinct article_id, vendor from {CHAIN}), v as (select vendor from vendor), u as (select source_id, vendor from article join f using (article_id) group by all)
    select s.source_id, bool_and(coalesce(u.vendor is not null, false)) as covered from (select distinct source_id from article) s cross join v left join u on u.source_id = s.source_id and u.vendor = v.vendor group by s.source_id""")
def _(t):
    cited = _chain(t).groupBy("source_id").agg(F.count_distinct("vendor").alias("n"))
    facets = t.vendor.agg(F.count("*").alias("facets"))
    return cited.join(F.broadcast(facets)).select("source_id", (F.col("n") == F.col("facets")).alias("covered"))  # one row


@query("agg_50_judged_quality", "select lang, round(avg(quality), 6) as rate, count(*) filter (quality is null) as unparsed from documents left join labels using (doc_id) group by lang")
def _(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("rate"), F.count_if(F.col("quality").isNull()).alias("unparsed"))


@query("top_5_batch_rerank", "select event_id, row_number() over (partition by user_id order by value is null, value desc, event_id) as place from events qualify place <= 8")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.col("value").isNull(), F.desc("value"), "event_id")
    return t.events.select("event_id", F.row_number().over(w).cast("long").alias("place")).filter("place <= 8")


@query("ds_7_weighted_pick", """select source, doc_id from documents qualify row_number() over (partition by source order by ln((('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::ubigint + 1) / 4294967296.0) / n_chars desc, doc_id) <= 5""")
def _(t):
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("u"), F.asc_nulls_last("doc_id"))
    return t.documents.withColumn("u", DS.weighted_key("doc_id", F.col("n_chars"))).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("source", "doc_id")


@query("ds_6_stratified_sample", """with g as (select lang, count(*) as n from documents group by lang), q as (select lang, n * 100.0 / (select sum(n) from g) as share from g), r as (select lang, floor(share) as base, row_number() over (order by share - floor(share) desc, lang) as rn from q),
    s as (select lang, base + (rn <= 100 - (select sum(base) from r))::int as seats from r) select doc_id, lang from documents join s using (lang) qualify row_number() over (partition by lang order by ln((('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::ubigint + 1) / 4294967296.0) desc, doc_id) <= max(seats) over (partition by lang)""")
def _(t):
    return DS.stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 100).select("doc_id", "lang")


@query("str_12_death_dates", "select article_id, min(died_at) as first_death, max(died_at) as last_death from episode where superseded group by article_id")
def _(t):
    return t.episode.filter("superseded").groupBy("article_id").agg(F.min("died_at").alias("first_death"), F.max("died_at").alias("last_death"))


@query("join_as_of", """select e.event_id, o.o_orderkey from events e asof join (select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey, o_orderdate order by o_orderkey desc) = 1) o on e.user_id = o.o_custkey and e.ts - interval 8000000 minutes >= o.o_orderdate""".replace("8000000 minutes", "9000 days"))
def _(t):
    """The last order before a shifted event time: both sides in one sorted stream, no pairs."""
    shifted = F.col("ts") - F.expr("interval 9000 days")
    e = t.events.select(F.col("user_id").alias("k"), shifted.alias("at"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o"))
    o = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("at", "side", "o").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w)).filter("side = 1 and o_orderkey is not null").select("event_id", "o_orderkey")


@query("join_30_evidence_cap")
def _(t):
    """Texts that a conversation's sources (roles) show, within a budget: copies of an earlier source's are pointers."""
    role = F.when(F.col("role") == "user", 0).otherwise(F.length("role") + 1).cast("long")
    return EV.capped(t.conversations.select(F.col("conv_id").alias("answer"), role.alias("source"), F.col("turn").alias("pos"), "text"), 600)


def _shortlist(t, n: int):
    scored = t.embeddings.filter("vec_id <> 0").select("vec_id", "label", V.cosine_or_zero(F.col("embedding"), F.array(*map(F.lit, query_vector(t)))).alias("score"))
    best = scored.groupBy("label").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "label").limit(n)
    return scored, best


_SHORT = """q as (select embedding as q from embeddings where vec_id = 0), s as (select vec_id, label, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::double * z[2]::double))
    / sqrt(list_sum(list_transform(embedding, lambda z: z::double * z::double)) * list_sum(list_transform(q, lambda z: z::double * z::double))) as score from embeddings, q where vec_id <> 0),
    best as (select label, max(score) as best from s group by label order by best desc, label limit {n})"""


