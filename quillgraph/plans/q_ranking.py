"""Window, ranking and dataset queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import strings as S
from quillgraph.operators import datasets as DS
from quillgraph.plans.canonical import query


@query("win_1_position", "select article_id, row_number() over (partition by source_id order by sort_order nulls last, article_id) - 1 as pos from article")
def _(t):
    w = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("sort_order"), "article_id")
    return t.article.select("article_id", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query("win_4_birth_episode", "select entity_id, min(episode_id) as born from mention group by entity_id")
def _(t):
    return t.mention.groupBy("entity_id").agg(F.min("episode_id").alias("born"))


@query("win_5_latest_wins", "select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("win_6_first_wins", "select user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))


@query("win_8_survivors", "select source_id, article_id from article qualify row_number() over (partition by source_id order by sort_order nulls last, changed_at, article_id) = 1")
def _(t):
    key = F.struct(F.col("sort_order").isNull(), "sort_order", "changed_at", "article_id")
    return t.article.groupBy("source_id").agg(F.min_by("article_id", key).alias("article_id"))


@query("win_9_top_member", "with d as (select src as entity_id, count(*) as n from fact group by src) select label, entity_id, n from d join entity using (entity_id) qualify row_number() over (partition by label order by n desc, entity_id) = 1")
def _(t):
    d = t.fact.groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("n")).join(t.entity.select("entity_id", "label"), "entity_id")
    return d.groupBy("label").agg(F.min_by(F.struct("entity_id", "n"), F.struct(-F.col("n"), F.col("entity_id"))).alias("m")).select("label", "m.entity_id", "m.n")


@query("win_10_recency", "select fact_id, row_number() over (partition by src order by invalid_at is not null, valid_at desc nulls last, fact_id) as place from fact")
def _(t):
    w = Window.partitionBy("src").orderBy(F.col("invalid_at").isNotNull(), F.desc_nulls_last("valid_at"), "fact_id")
    return t.fact.select("fact_id", F.row_number().over(w).cast("long").alias("place"))


@query("win_11_round_robin", """with r as (select fact_id, src, dst, row_number() over (partition by dst, src order by valid_at desc, fact_id) as depth from fact)
    select fact_id, row_number() over (partition by dst order by depth, src) as place from r""")
def _(t):
    w = Window.partitionBy("dst", "src").orderBy(F.desc("valid_at"), "fact_id")
    r = t.fact.select("fact_id", "src", "dst", F.row_number().over(w).alias("depth"))
    return r.select("fact_id", F.row_number().over(Window.partitionBy("dst").orderBy("depth", "src")).cast("long").alias("place"))


@query("win_16_citation_numbers", "with f as (select user_id, event_type, min(event_id) as first from events group by all) select user_id, event_type, dense_rank() over (partition by user_id order by first) as number from f")
def _(t):
    f = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return f.select("user_id", "event_type", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("number"))


@query("top_7_chronological", "select fact_id, valid_at from fact order by valid_at nulls last, fact_id limit 100")
def _(t):
    return t.fact.orderBy(F.asc_nulls_last("valid_at"), "fact_id").limit(100).select("fact_id", "valid_at")


@query("top_9_claim_order", "select job_id from job where status = 'pending' order by lane = 'bootstrap', enqueued_at, job_id limit 40")
def _(t):
    return t.job.filter("status = 'pending'").orderBy(F.col("lane") == "bootstrap", "enqueued_at", "job_id").limit(40).select("job_id")


@query("top_11_bounded_samples", "select source, array_to_string(list_sort(list(doc_id))[1:20], ',') as sample from documents group by source")
def _(t):
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))  # cut to 20 before the shuffle
    first = t.documents.select("source", "doc_id", rn.alias("rn")).filter("rn <= 20")
    return first.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))


@query("top_12_floors_and_caps", """with g as (select source, count(*)::double as n, 5.0 as lo, 40.0 as hi from documents group by source), bend as (select lo / n as bend_at from g union select hi / n from g),
    s as (select bend_at, sum(least(hi, greatest(lo, bend_at * n))) as s, sum(n) filter (bend_at * n >= lo - 1e-9 and bend_at * n < hi - 1e-9) as slope from bend, g group by bend_at), piece as (select * from s where s <= 137 + 1e-9 order by bend_at desc limit 1),
    q as (select source, least(hi, greatest(lo, n * (select case when slope > 0 then bend_at + (137 - s) / slope else bend_at end from piece))) as share from g), b as (select source, floor(share + 1e-9) as base, round(share - floor(share + 1e-9), 9) as rest from q),
    r as (select *, row_number() over (order by rest desc, source) as rn from b) select source, (base + (rest > 0 and rn <= 137 - (select sum(base) from b))::int)::bigint as seats from r""")
def _(t):
    """137 seats for sources in proportion to their documents, five at least and forty at most."""
    g = t.documents.groupBy("source").agg(F.count("*").alias("n")).withColumns({"lo": F.lit(5), "hi": F.lit(40)})
    return DS.clamped_seats(g, "source", "n", 137, "lo", "hi")


@query("top_12_apportion", """with g as (select source, count(*) as n from documents group by source), q as (select source, n * 137.0 / (select sum(n) from g) as share from g),
    r as (select source, floor(share) as base, row_number() over (order by share - floor(share) desc, source) as rn from q) select source, (base + (rn <= 137 - (select sum(base) from r))::int)::bigint as seats from r""")
def _(t):
    return DS.apportion(t.documents.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 137)


@query("ds_1_hash_split", """select doc_id, case when ('0x' || substr(sha256(source), 1, 8))::ubigint / 4294967295.0 < 0.1 then 'val' else 'train' end as part from documents""")
def _(t):
    return t.documents.select("doc_id", F.when(S.hash_fraction(F.col("source")) < 0.1, "val").otherwise("train").alias("part"))


@query("ds_2_mix_weights", """with g as (select lang, sum(n_chars) as chars, count(*) as n from documents group by lang), w as (select lang, n, case lang when 'en' then 0.4 else 0.2 end / (chars * 1.0 / (select sum(chars) from g)) as w from g)
    select lang, round(w / (select sum(w * n) / sum(n) from w), 6) as weight from w""")
def _(t):
    return DS.mix_weights(t.documents, "lang", "n_chars", {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}).withColumn("weight", F.round("weight", 6))


@query("ds_3_upsample", """with g as (select lang, count(*) as n from documents group by lang), r as (select lang, least(4, greatest(1, round_even((select max(n) from g) * 1.0 / n, 0)))::int as k from g)
    select doc_id, unnest(range(0, k)) as repeat_index from documents join r using (lang)""")
def _(t):
    return DS.upsample(t.documents.select("doc_id", "lang"), "lang", 4).select("doc_id", F.col("repeat_index").cast("long").alias("repeat_index"))


@query("ds_4_drop_overlong", "select doc_id from documents where floor(length(text) / 4) <= 500")
def _(t):
    return t.documents.filter(S.approx_tokens(F.col("text")) <= 500).select("doc_id")


@query("ds_5_downsample", "select doc_id from documents qualify row_number() over (partition by lang order by md5(cast(doc_id as varchar)), doc_id) <= 60")
def _(t):
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return t.documents.select("doc_id", F.row_number().over(w).alias("rn")).filter("rn <= 60").select("doc_id")


@query("ds_6_weighted_sample", """select doc_id from documents qualify row_number() over (order by ln((('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8))::ubigint + 1) / 4294967296.0) / n_chars desc, doc_id) <= 100""")
def _(t):
    return DS.weighted_sample(t.documents, "doc_id", F.col("n_chars"), 100).select("doc_id")


@query("ds_10_undo_upsampling", "select doc_id, min(n_chars) as n_chars from documents group by doc_id")
def _(t):
    return DS.upsample(t.documents.select("doc_id", "lang", "n_chars"), "lang", 4).filter("repeat_index = 0").select("doc_id", "n_chars")
