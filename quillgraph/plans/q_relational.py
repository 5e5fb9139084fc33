"""Queries over the chain, facts and jobs: sources, filters, projections, joins, aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import strings as S
from quillgraph.functions import rules as R
from quillgraph.operators import evals as E
from quillgraph.operators import graphs as G
from quillgraph.operators import provenance as P
from quillgraph.operators.retrieval import is_current, neighbours, temporal_status
from quillgraph.plans.canonical import AS_OF, now, query
from quillgraph.plans.q_rules import NOISE
from quillgraph.sources import feed

CHAIN = "article join source using (source_id) join product using (product_id) join vendor using (vendor_id)"


def _chain(t):
    return P.chain(t.article, t.source, t.product, t.vendor)


# Sources and sinks -------------------------------------------------------------------------------------------------


@query("src_3_pushed_scan", "select event_id, user_id, value from events where event_id > 500 and user_id = 7")
def _(t):
    return feed.scan(t.events, {"user_id": 7, "event_type": None}, after=("event_id", 500)).select("event_id", "user_id", "value")


@query("src_6_catalog_load", "select source_id, source, product, coalesce(vendor, '') as vendor from source join product using (product_id) left join vendor using (vendor_id)")
def _(t):
    joined = t.source.join(t.product, "product_id").join(t.vendor, "vendor_id", "left")
    return joined.select("source_id", "source", "product", F.coalesce("vendor", F.lit("")).alias("vendor"))


@query("src_7_structural_upsert", """with new as (select source_id, upper(source) as source, product_id from source where balance < 0 union all select source_id + 1000000000, source, product_id from source where kind = 'BUILDING')
    select coalesce(n.source_id, o.source_id) as source_id, coalesce(n.source, o.source) as source, coalesce(n.product_id, o.product_id) as product_id
    from source o full outer join new n on n.source_id = o.source_id""")  # fmt: skip
def _(t):
    old, given = t.source.select("source_id", "source", "product_id"), t.source.select("source_id", "source", "product_id", "balance", "kind")
    new = given.filter("balance < 0").withColumn("source", F.upper("source"))
    new = new.unionByName(given.filter("kind = 'BUILDING'").withColumn("source_id", F.col("source_id") + 1000000000)).drop("balance", "kind")
    return feed.upsert(old, new, ["source_id"])


@query("src_8_prune_and_rewire", """with p as (select article_id from article where title = '1-URGENT') select episode_id, article_id, chunk_index from episode where article_id not in (select article_id from p)
    union all select episode_id, article_id, chunk_index + 100 from episode where article_id in (select article_id from p) and chunk_index <= 3""")  # fmt: skip
def _(t):
    old = t.episode.select("episode_id", "article_id", "chunk_index")
    part = t.article.filter("title = '1-URGENT'").select("article_id")
    new = old.filter("chunk_index <= 3").join(part, "article_id", "left_semi").withColumn("chunk_index", F.col("chunk_index") + 100)
    return feed.replace_partition(old, new.select(*old.columns), part)


@query("src_9_tombstones", """select a.article_id, removed or d.article_id is not null as removed, d.at as removed_at from article a
    left join (select user_id as article_id, cast(max(ts) as varchar) as at from events where event_type = 'error' group by user_id) d on a.article_id = d.article_id""")
def _(t):
    dead = t.events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("article_id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("removed_at"), F.max("ts").alias("_t"))
    dead = dead.withColumn("removed_at", F.col("_t").cast("string")).drop("_t")
    return t.article.select("article_id", "removed").join(dead, "article_id", "left").select("article_id", (F.col("removed") | F.col("removed_at").isNotNull()).alias("removed"), "removed_at")


@query("src_10_document_replace", """select doc_id, sha256(text) as hash, 'kept' as state from documents where lang <> 'de'
    union all select doc_id, sha256(text || '!'), 'replaced' from documents where lang = 'de'""")  # fmt: skip
def _(t):
    old = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    new = t.documents.select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return feed.hash_gate(old, new, "doc_id", "hash").select("doc_id", "hash", F.when(F.col("changed"), "replaced").otherwise("kept").alias("state"))


@query("src_11_ingest_report", """select source, count(*) as fetched, count(*) filter (text is null or text = '') as skipped, count(*) filter (n_chars > 4000) as long, cast(sum(n_chars) as bigint) as chars
    from documents group by source""")  # fmt: skip
def _(t):
    return t.documents.groupBy("source").agg(
        F.count("*").alias("fetched"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("skipped"), F.count_if(F.col("n_chars") > 4000).alias("long"), F.sum("n_chars").alias("chars")
    )


@query("src_12_corpus_export", f"""select article_id, vendor, product, source from {CHAIN} where not removed
    qualify row_number() over (partition by article_id order by vendor, product, source) = 1""")  # fmt: skip
def _(t):
    first = F.min(F.struct("vendor", "product", "source")).alias("f")
    return _chain(t).filter(~F.col("removed")).groupBy("article_id").agg(first).select("article_id", "f.vendor", "f.product", "f.source")


@query("src_14_article_fetch", "select a.article_id, a.title, d.n_chars, cast(a.changed_at as date) as changed from article a join documents d on d.doc_id = a.article_id")
def _(t):
    return t.article.join(t.documents.select(F.col("doc_id").alias("article_id"), "n_chars"), "article_id").select("article_id", "title", "n_chars", F.to_date("changed_at").alias("changed"))


@query("src_17_articles_of_source", "select source_id, article_id, row_number() over (partition by source_id order by sort_order nulls last, article_id) as place from article where not removed")
def _(t):
    w = Window.partitionBy("source_id").orderBy(F.asc_nulls_last("sort_order"), "article_id")
    return t.article.filter(~F.col("removed")).select("source_id", "article_id", F.row_number().over(w).cast("long").alias("place"))


@query("src_19_resume", """select e.event_id, e.user_id from events e where e.event_type = 'view' and not exists (
    select 1 from events d where d.user_id = e.user_id and d.event_type in ('purchase', 'error') and d.value > 400)""")
def _(t):
    done = t.events.filter("event_type in ('purchase', 'error') and value > 400").select("user_id")
    return t.events.filter("event_type = 'view'").join(done, "user_id", "left_anti").select("event_id", "user_id")


# Filters and projections -------------------------------------------------------------------------------------------


@query("flt_1_current_facts", f"select fact_id, src, dst from fact where invalid_at is null or invalid_at > timestamp '{AS_OF}'")
def _(t):
    return t.fact.filter(is_current(F.col("invalid_at"), now())).select("fact_id", "src", "dst")


@query("flt_2_status", f"""select case when invalid_at is null or invalid_at > timestamp '{AS_OF}' then 'current' when relation = 'R' then 'expired' else 'superseded' end as status, count(*) as n
    from fact group by all""")  # fmt: skip
def _(t):
    return t.fact.groupBy(temporal_status(F.col("invalid_at"), now(), F.col("relation") == "R").alias("status")).agg(F.count("*").alias("n"))


@query("flt_3_scope", f"select article_id from {CHAIN} where lower(vendor) in ('asia', 'europe') or lower(product) = 'nation_3' or lower(source) = 'customer#000000007'")
def _(t):
    return _chain(t).filter(P.scope_condition(["Asia", "EUROPE"], ["nation_3"], ["Customer#000000007"])).select("article_id")


@query("flt_4_vendor_or_product", f"select vendor, product, count(*) as n from {CHAIN} where vendor_id = 1 or product_id in (2, 5) group by all")
def _(t):
    return _chain(t).filter((F.col("vendor_id") == 1) | F.col("product_id").isin(2, 5)).groupBy("vendor", "product").agg(F.count("*").alias("n"))


@query("flt_7_dense_tables", r"""with l as (select doc_id, string_split(rtrim(text, chr(10)), chr(10)) as lines, text from documents)
    select doc_id, (len(list_filter(lines, lambda x: x like '%|%')) >= 0.25 * len(lines) or length(text) - length(replace(text, '|', '')) >= 200) as dense from l""")
def _(t):
    lines = F.split(F.rtrim("text", F.lit("\n")), "\n", -1)
    piped = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    pipes = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    return t.documents.select("doc_id", ((piped >= 0.25 * F.size(lines)) | (pipes >= 200)).alias("dense"))


@query("flt_12_liveness", """select e.episode_id, (not coalesce(superseded, false) and not coalesce(removed, false)) as alive from episode e left join article a on a.article_id = e.article_id""")
def _(t):
    joined = t.episode.join(t.article.select("article_id", "removed"), "article_id", "left")
    return joined.select("episode_id", P.alive(F.col("superseded"), F.col("removed"), F.lit(None).cast("boolean")).alias("alive"))


@query("flt_15_same_name", """with k as (select entity_id, name, array_to_string(regexp_extract_all(lower(replace(name, '&', ' and ')), '[a-z0-9]+'), ' ') as key from entity)
    select key, count(*) as n, min(entity_id) as first from k group by key""")
def _(t):
    return t.entity.groupBy(S.token_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min("entity_id").alias("first"))


@query("flt_18_skip_reason", """select doc_id, case when source = 'src3' then 'excluded' when n_chars < 100 then 'empty' when n_chars > 5000 then 'too_long' when contains(text, ' | ') then 'dense' else 'kept' end as reason from documents""")
def _(t):
    c = F.col
    reason = F.when(c("source") == "src3", "excluded").when(c("n_chars") < 100, "empty").when(c("n_chars") > 5000, "too_long").when(F.contains("text", F.lit(" | ")), "dense").otherwise("kept")
    return t.documents.select("doc_id", reason.alias("reason"))


@query("flt_29_already_ingested", """select n.episode_id from episode n where exists (select 1 from episode o where o.article_id = n.article_id and o.chunk_index = n.chunk_index and not o.superseded and o.tokens = n.tokens)""")
def _(t):
    old = t.episode.filter(~F.col("superseded")).select("article_id", "chunk_index", "tokens")
    return t.episode.join(old, ["article_id", "chunk_index", "tokens"], "left_semi").select("episode_id")


@query("prj_1_structural_rows", "select article_id as id, concat('article/', cast(article_id as varchar)) as key, source_id as parent, upper(title) as label from article")
def _(t):
    return t.article.select(F.col("article_id").alias("id"), F.concat(F.lit("article/"), F.col("article_id").cast("string")).alias("key"), F.col("source_id").alias("parent"), F.upper("title").alias("label"))


@query("prj_3_labels", f"""with s as (select distinct fact_id, vendor, product from fact_episode join episode using (episode_id) join {CHAIN} using (article_id))
    select fact_id, '(' || string_agg(vendor || ' · ' || product, '; ' order by vendor, product) || ')' as label from s group by fact_id""")
def _(t):
    pairs = P.fact_sources(t.fact_episode, t.episode, _chain(t)).select("fact_id", F.concat("vendor", F.lit(" · "), "product").alias("l")).distinct()
    return pairs.groupBy("fact_id").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("l")), "; "), F.lit(")")).alias("label"))


@query("prj_4_first_custom_label", "select entity_id, coalesce(list_filter([label, 'Entity'], lambda x: x <> 'Entity' and x <> 'Brand#11')[1], 'Entity') as label from entity")
def _(t):
    labels = F.filter(F.array("label", F.lit("Entity")), lambda x: ~x.isin("Entity", "Brand#11"))
    return t.entity.select("entity_id", F.coalesce(F.get(labels, F.lit(0)), F.lit("Entity")).alias("label"))


@query("prj_5_evidence_blocks", """with l as (select relation, fact_id, score, row_number() over (partition by relation order by score desc, fact_id) as rn from fact)
    select relation, '## ' || relation || chr(10) || string_agg('[' || rn || '] ' || fact_id, chr(10) order by rn) as block from l where rn <= 5 group by relation""")
def _(t):
    w = Window.partitionBy("relation").orderBy(F.desc("score"), "fact_id")  # ranks up to five are cut before the shuffle
    top = t.fact.select("relation", "fact_id", F.row_number().over(w).alias("rn")).filter("rn <= 5")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact_id"))), lambda x: F.format_string("[%d] %d", x["rn"], x["fact_id"]))
    return top.groupBy("relation").agg(F.concat(F.lit("## "), "relation", F.lit("\n"), F.array_join(lines, "\n")).alias("block"))


@query("prj_6_timeline", """select src, string_agg(coalesce(strftime(valid_at, '%Y-%m-%d'), 'no recorded start') || ' ' || relation, ' > ' order by valid_at, fact_id) as line from fact group by src""")
def _(t):
    entry = F.struct("valid_at", "fact_id", F.concat(F.coalesce(F.date_format("valid_at", "yyyy-MM-dd"), F.lit("no recorded start")), F.lit(" "), "relation").alias("l"))
    return t.fact.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["l"]), " > ").alias("line"))


# Joins -------------------------------------------------------------------------------------------------------------


@query("join_1_provenance", f"""with p as (select distinct fact_id, article_id, source, vendor from fact_episode join episode using (episode_id) join {CHAIN} using (article_id))
    select f.fact_id, count(p.article_id) as sources, coalesce(min(p.vendor), '') as vendor from fact f left join p on p.fact_id = f.fact_id group by f.fact_id""")
def _(t):
    p = P.fact_sources(t.made("fact_episode"), t.made("episode"), _chain(t)).select("fact_id", "article_id", "vendor")
    return t.made("fact").select("fact_id").join(p, "fact_id", "left").groupBy("fact_id").agg(F.count("article_id").alias("sources"), F.coalesce(F.min("vendor"), F.lit("")).alias("vendor"))


@query("join_2_provenance_inner", f"select distinct fact_id, article_id, title, source from fact_episode join episode using (episode_id) join {CHAIN} using (article_id)")
def _(t):
    links = t.fact_episode.join(t.episode.select("episode_id", "article_id"), "episode_id").select("fact_id", "article_id").distinct()
    return links.join(_chain(t).select("article_id", "title", "source"), "article_id").select("fact_id", "article_id", "title", "source")


@query("join_3_scope_episodes", f"select distinct episode_id from episode join {CHAIN} using (article_id) where vendor = 'ASIA' or product = 'NATION_7'")
def _(t):
    scope = _chain(t).filter(P.scope_condition(["asia"], ["nation_7"])).select("article_id")
    return t.episode.join(scope, "article_id", "left_semi").select("episode_id").distinct()


@query("join_4_bounded_scope", f"""select episode_id from episode where tokens > 40 and article_id in (select article_id from {CHAIN} where vendor_id = 2)""")
def _(t):
    return t.episode.filter("tokens > 40").join(_chain(t).filter("vendor_id = 2").select("article_id"), "article_id", "left_semi").select("episode_id")


@query("join_5_sources_with_content", "select source_id, source from source where exists (select 1 from article join episode using (article_id) where article.source_id = source.source_id)")
def _(t):
    with_content = t.article.join(t.episode.select("article_id"), "article_id", "left_semi").select("source_id")
    return t.source.join(with_content, "source_id", "left_semi").select("source_id", "source")


@query("join_6_stranded_articles", """select article_id from article where not removed and not exists (select 1 from episode where episode.article_id = article.article_id and not superseded) and not exists (select 1 from job where job.article_id = article.article_id)""")
def _(t):
    live = t.episode.filter(~F.col("superseded")).select("article_id")
    return t.article.filter(~F.col("removed")).select("article_id").join(live, "article_id", "left_anti").join(t.job.select("article_id"), "article_id", "left_anti")


@query("join_7_scoped_facts", f"""with scope as (select episode_id from episode join {CHAIN} using (article_id) where vendor_id = 3)
    select f.fact_id, f.score from fact f where exists (select 1 from fact_episode x join scope using (episode_id) where x.fact_id = f.fact_id)""")
def _(t):
    scope = t.episode.join(_chain(t).filter("vendor_id = 3").select("article_id"), "article_id", "left_semi").select("episode_id")
    return t.fact.join(t.fact_episode.join(scope, "episode_id", "left_semi").select("fact_id"), "fact_id", "left_semi").select("fact_id", "score")


@query("join_9_reconcile", """with s as (select product_id, lower(replace(product, '_', ' ')) as form from product union select product_id, lower(product) from product),
    e as (select entity_id, lower('nation_' || (size % 30)) as name, size % 2 = 0 as right_kind from entity)
    select p.product_id, case when bool_or(right_kind) then 'matched' when count(entity_id) > 0 then 'wrong_type_candidate' else 'no_candidate' end as state, min(entity_id) filter (right_kind) as twin
    from product p left join s on s.product_id = p.product_id left join e on e.name = s.form group by p.product_id""")
def _(t):
    forms = t.product.select("product_id", F.explode(F.array_distinct(F.array(F.lower(F.replace("product", F.lit("_"), F.lit(" "))), F.lower("product")))).alias("form"))
    e = t.entity.select("entity_id", F.lower(F.concat(F.lit("nation_"), (F.col("size") % 30).cast("string"))).alias("form"), (F.col("size") % 2 == 0).alias("right"))
    found = forms.join(e, "form").groupBy("product_id").agg(F.bool_or("right").alias("ok"), F.min(F.when(F.col("right"), F.col("entity_id"))).alias("twin"))
    state = F.when(F.col("ok"), "matched").when(F.col("ok").isNotNull(), "wrong_type_candidate").otherwise("no_candidate")
    return t.product.select("product_id").join(found, "product_id", "left").select("product_id", state.alias("state"), "twin")


@query("join_10_intra_community_facts", "select a.label as community, count(*) as facts from fact f join entity a on a.entity_id = f.src join entity b on b.entity_id = f.dst and a.label = b.label group by a.label")
def _(t):
    m = t.entity.select("entity_id", "label")
    a, b = m.select(F.col("entity_id").alias("src"), F.col("label").alias("community")), m.select(F.col("entity_id").alias("dst"), F.col("label").alias("community"))
    return t.fact.join(a, "src").join(b, ["dst", "community"]).groupBy("community").agg(F.count("*").alias("facts"))


@query("join_11_intra_degree", """with i as (select f.src, f.dst, a.label from fact f join entity a on a.entity_id = f.src join entity b on b.entity_id = f.dst and a.label = b.label),
    d as (select src as n from i union all select dst from i) select entity_id, label, count(n) as degree from entity left join d on n = entity_id group by entity_id, label""")
def _(t):
    m = t.entity.select("entity_id", "label")
    inside = t.fact.join(m.select(F.col("entity_id").alias("src"), F.col("label").alias("c")), "src").join(m.select(F.col("entity_id").alias("dst"), F.col("label").alias("c")), ["dst", "c"])
    ends = inside.select(F.col("src").alias("entity_id")).unionByName(inside.select(F.col("dst").alias("entity_id"))).groupBy("entity_id").agg(F.count("*").alias("degree"))
    return m.join(ends, "entity_id", "left").select("entity_id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("join_18_neighbours", """select distinct c.episode_id from episode c join episode h on h.article_id = c.article_id and c.chunk_index between h.chunk_index - 1 and h.chunk_index + 1 where h.tokens > 60""")
def _(t):
    e = t.episode
    return neighbours(e.filter("tokens > 60"), e).select("episode_id")


@query("join_19_support", """with s as (select e.episode_id, (not coalesce(superseded, false) and not coalesce(removed, false)) as alive, died_at from episode e left join article a on a.article_id = e.article_id)
    select fact_id, count(*) as episodes, count(*) filter (alive) as alive, max(died_at) as died_at from fact join fact_episode using (fact_id) left join s using (episode_id) group by fact_id""")
def _(t):
    return P.support(t.fact, t.fact_episode, t.episode, t.article)


@query("join_20_full_outer_replies", """with p as (select doc_id from labels where quality = 1), g as (select doc_id from labels where toxic = 0)
    select count(*) filter (p.doc_id is null) as stray, count(*) filter (g.doc_id is null) as missing, count(*) filter (p.doc_id = g.doc_id) as both from p full outer join g on p.doc_id = g.doc_id""")
def _(t):
    p = t.labels.filter("quality = 1").select("doc_id", F.lit(1).alias("p"))
    g = t.labels.filter("toxic = 0").select("doc_id", F.lit(1).alias("g"))
    return p.join(g, "doc_id", "full_outer").agg(F.count_if(F.col("p").isNull()).alias("stray"), F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("both"))


@query("join_21_one_or_two_hops", """select src, count(distinct dst) as reached from (select src, dst from fact union select a.src, b.dst from fact a join fact b on a.dst = b.src) group by src""")
def _(t):
    return G.reached_in_two(t.fact)


@query("join_22_facet_assignment", f"""select article_id, case when vendor_id = 1 then 'v1' when product_id in (2, 8, 14) then 'listed' when kind = 'BUILDING' then 'building' end as facet from {CHAIN} where vendor_id = 1 or product_id in (2, 8, 14) or kind = 'BUILDING'""")
def _(t):
    facet = F.when(F.col("vendor_id") == 1, "v1").when(F.col("product_id").isin(2, 8, 14), "listed").when(F.col("kind") == "BUILDING", "building")
    return _chain(t).join(t.source.select("source_id", "kind"), "source_id").select("article_id", facet.alias("facet")).filter("facet is not null")


@query("join_24_backfill", """select job_id, coalesce(case when j.source_id > 5 then j.source_id end, a.source_id) as source_id, a.article_id is null as missing from job j left join article a on a.article_id = j.article_id""")
def _(t):
    j = t.job.select("job_id", "article_id", F.when(F.col("source_id") > 5, F.col("source_id")).alias("own"))
    a = t.article.select("article_id", "source_id", F.lit(True).alias("there"))
    return j.join(a, "article_id", "left").select("job_id", F.coalesce("own", "source_id").alias("source_id"), F.col("there").isNull().alias("missing"))


@query("join_25_document_context", f"""with c as (select d.doc_id, source_id, vendor from documents d join {CHAIN} on d.doc_id = article.article_id)
    select d.doc_id, coalesce(min_by(c.vendor, c.source_id), '') as vendor, count(c.source_id) as chains from documents d left join c on c.doc_id = d.doc_id group by d.doc_id""")
def _(t):
    c = _chain(t).select(F.col("article_id").alias("doc_id"), "source_id", "vendor")
    return t.documents.select("doc_id").join(c, "doc_id", "left").groupBy("doc_id").agg(F.coalesce(F.min_by("vendor", "source_id"), F.lit("")).alias("vendor"), F.count("source_id").alias("chains"))


@query("join_26_attribution_by_text", """with h as (select doc_id, source, md5(text) as h from documents), c as (select h, count(distinct source) as sources, min(source) as source from h group by h)
    select doc_id, case when sources = 1 then c.source end as attributed, case when sources > 1 then 'ambiguous' else 'ok' end as reason from h join c using (h)""")
def _(t):
    h = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    c = h.groupBy("h").agg(F.count_distinct("source").alias("n"), F.min("source").alias("s"))
    return h.join(c, "h").select("doc_id", F.when(F.col("n") == 1, F.col("s")).alias("attributed"), F.when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("reason"))


@query("join_29_facet_subsumption", f"""with f as (select distinct vendor, case when product like '%3' then product end as product from {CHAIN}) select vendor, product from f where product is not null or not exists (select 1 from f g where g.vendor = f.vendor and g.product is not null)""")
def _(t):
    f = _chain(t).select("vendor", F.when(F.col("product").like("%3"), F.col("product")).alias("product")).distinct()
    narrow = f.filter("product is not null")
    return narrow.unionByName(f.filter("product is null").join(narrow.select("vendor"), "vendor", "left_anti").select("vendor", "product"))


# Aggregations ------------------------------------------------------------------------------------------------------


@query("agg_1_queue_depth", "select source_id, status, count(*) as n from job group by all")
def _(t):
    return t.job.groupBy("source_id", "status").agg(F.count("*").alias("n"))


@query("agg_2_recent_by_vendor", f"""select vendor, count(*) as n from job join source on source.source_id = job.source_id join product using (product_id) join vendor using (vendor_id)
    where status = 'done' and enqueued_at >= timestamp '2024-01-15' group by vendor""")
def _(t):
    recent = t.job.filter((F.col("status") == "done") & (F.col("enqueued_at") >= F.expr("timestamp_ntz'2024-01-15 00:00:00'"))).groupBy("source_id").agg(F.count("*").alias("n"))
    return recent.join(t.source, "source_id").join(t.product, "product_id").join(t.vendor, "vendor_id").groupBy("vendor").agg(F.sum("n").alias("n"))


@query("agg_3_scalar_counts", "select count(*) filter (status = 'pending' and attempts > 0) as retrying, count(*) filter (status = 'dead') as dead, count(distinct article_id) as articles from job")
def _(t):
    return t.job.agg(F.count_if((F.col("status") == "pending") & (F.col("attempts") > 0)).alias("retrying"), F.count_if(F.col("status") == "dead").alias("dead"), F.count_distinct("article_id").alias("articles"))


@query("agg_4_token_ledger", "select cast(enqueued_at as date) as day, round(sum(coalesce(tokens, 0)), 4) as tokens from job group by 1")
def _(t):
    return t.job.groupBy(F.to_date("enqueued_at").alias("day")).agg(F.round(F.sum(F.coalesce("tokens", F.lit(0.0))), 4).alias("tokens"))


@query("agg_5_percentiles", """select source, percentile_disc(0.5) within group (order by n_chars) as p50, percentile_disc(0.9) within group (order by n_chars) as p90, percentile_disc(0.99) within group (order by n_chars) as p99,
    max(n_chars) as most, count(*) filter (n_chars > 3000) as long from documents group by source""")
def _(t):
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by n_chars)").cast("long").alias(f"p{int(q * 100)}")
    return t.documents.groupBy("source").agg(p(0.5), p(0.9), p(0.99), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 3000).alias("long"))


@query("agg_6_nearest_rank", """select label, list_sort(list(price))[cast(round_even(0.9 * (count(*) - 1), 0) as bigint) + 1] as p90 from entity group by label""")
def _(t):
    return E.at_rank(t.entity, "label", "price", lambda n: F.bround(0.9 * (n - 1)) + 1).select("label", F.col("price").alias("p90"))


@query("agg_8_usage_tally", """select op, count(*) as calls, round(sum(tokens), 4) as tokens, round(sum(tokens) filter (attempts > 1) / nullif(sum(tokens), 0), 6) as retry_share from job group by op""")
def _(t):
    retry = F.sum(F.when(F.col("attempts") > 1, F.col("tokens")))
    return t.job.groupBy("op").agg(F.count("*").alias("calls"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.try_divide(retry, F.sum("tokens")), 6).alias("retry_share"))


@query("agg_9_pooled_ratios", """select source, round(avg(quality), 6) as mean, round(median(quality), 6) as med, round(sum(toxic) / nullif(sum(quality), 0), 6) as pooled from labels join documents using (doc_id) group by source""")
def _(t):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.round(F.avg("quality"), 6).alias("mean"), F.round(F.median("quality"), 6).alias("med"), F.round(F.try_divide(F.sum("toxic").cast("double"), F.sum("quality")), 6).alias("pooled")
    )


@query("agg_10_grouping_sets", "select lang, source, grouping(source)::bigint as all_sources, count(*) as n, round(avg(n_chars), 4) as mean from documents group by grouping sets ((lang), (lang, source))")
def _(t):
    docs = t.documents.select("lang", "source", "n_chars")
    return docs.groupingSets([[F.col("lang")], [F.col("lang"), F.col("source")]], "lang", "source").agg(F.grouping("source").cast("long").alias("all_sources"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("agg_11_null_skipping_rollup", """select lang, count(*) as n, count(quality) as scored, count(*) - count(quality) as unscored, round(avg(quality), 6) as mean from documents left join labels using (doc_id) group by lang""")
def _(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n"), F.count("quality").alias("scored"), F.count_if(F.col("quality").isNull()).alias("unscored"), F.round(F.avg("quality"), 6).alias("mean")
    )


@query("agg_12_majority_vote", """with v as (select user_id, count(*) filter (value > 250) as yes, count(*) as n from events group by user_id)
    select user_id, case when n >= 2 and 2 * yes <> n then 2 * yes > n end as verdict from v""")
def _(t):
    v = t.events.groupBy("user_id").agg(F.count_if(F.col("value") > 250).alias("yes"), F.count("*").alias("n"))
    return v.select("user_id", E.majority(F.col("yes"), F.col("n")).alias("verdict"))


@query("agg_13_cross_vendor_names", f"select title, count(distinct vendor) as vendors from {CHAIN} group by title having count(distinct vendor) > 1")
def _(t):
    return _chain(t).groupBy("title").agg(F.count_distinct("vendor").alias("vendors")).filter("vendors > 1")


@query("agg_14_live_articles", "select source_id, count(distinct article_id) as live from article join episode using (article_id) where not superseded and not removed group by source_id having count(distinct article_id) >= 3")
def _(t):
    live = t.article.filter(~F.col("removed")).join(t.episode.filter(~F.col("superseded")).select("article_id"), "article_id", "left_semi")
    return live.groupBy("source_id").agg(F.count_distinct("article_id").alias("live")).filter("live >= 3")


@query("agg_15_catalog_stats", f"select vendor, product, count(distinct article_id) as articles from {CHAIN} where exists (select 1 from episode where episode.article_id = article.article_id) group by all")
def _(t):
    return _chain(t).join(t.episode.select("article_id"), "article_id", "left_semi").groupBy("vendor", "product").agg(F.count_distinct("article_id").alias("articles"))


@query("agg_16_applies_to", f"""with p as (select distinct fact_id, vendor, product from fact_episode join episode using (episode_id) join {CHAIN} using (article_id))
    select vendor, count(distinct fact_id) as facts, string_agg(distinct product, ',' order by product) as products from p group by vendor""")
def _(t):
    p = P.fact_sources(t.fact_episode, t.episode, _chain(t))
    return p.groupBy("vendor").agg(F.count_distinct("fact_id").alias("facts"), F.array_join(F.array_sort(F.collect_set("product")), ",").alias("products"))


@query("agg_17_duplicate_excess", "select cast(coalesce(sum(n - 1), 0) as bigint) as excess from (select count(*) as n from documents group by text having count(*) > 1)")
def _(t):
    g = t.documents.groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


@query("agg_20_edge_weights", "select src, dst, count(*) as weight from fact group by all")
def _(t):
    return t.fact.groupBy("src", "dst").agg(F.count("*").alias("weight"))


@query("agg_21_corpus_cursor", "select max(x) as cursor from (select max(valid_at) as x from fact union all select max(invalid_at) from fact where relation = 'R' union all select max(changed_at) from article)")
def _(t):
    tops = t.fact.agg(F.max("valid_at").alias("x")).unionByName(t.fact.filter("relation = 'R'").agg(F.max("invalid_at").alias("x"))).unionByName(t.article.agg(F.max("changed_at").alias("x")))
    return tops.agg(F.max("x").alias("cursor"))


@query("agg_22_label_histogram", "select l as label, count(*) as n from (select unnest([label, kind, 'Entity']) as l from entity) where l <> 'Entity' group by l")
def _(t):
    return t.entity.select(F.explode(F.array("label", "kind", F.lit("Entity"))).alias("label")).filter("label <> 'Entity'").groupBy("label").agg(F.count("*").alias("n"))


@query("agg_23_noise_rate", f"""with e as (select entity_id, rule <> 'kept' as noisy from {NOISE}), f as (select coalesce(a.noisy, false) or coalesce(b.noisy, false) as noisy from fact left join e a on a.entity_id = src left join e b on b.entity_id = dst)
    select (select count(*) from e where noisy) as entities, (select count(*) from f where noisy) as facts, round((select avg(noisy::int) from f), 6) as rate""")
def _(t):
    e = t.entity_name.select("entity_id", R.noise(F.col("name")).isNotNull().alias("noisy"))
    f = t.fact.join(e.select(F.col("entity_id").alias("src"), F.col("noisy").alias("a")), "src", "left").join(e.select(F.col("entity_id").alias("dst"), F.col("noisy").alias("b")), "dst", "left")
    bad = F.coalesce("a", F.lit(False)) | F.coalesce("b", F.lit(False))
    counts = f.agg(F.count_if(bad).alias("facts"), F.round(F.avg(bad.cast("int")), 6).alias("rate"))
    return e.agg(F.count_if("noisy").alias("entities")).join(F.broadcast(counts))  # one row each


@query("agg_29_sign_test", """with s as (select source, count(*) filter (quality > toxic) as w, count(*) filter (quality < toxic) as l from labels join documents using (doc_id) group by source)
    select source, w as wins, l as losses, round(case when w + l = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda k: exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1)))) / pow(2.0, w + l)) end, 6) as p from s""")
def _(t):
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.expr("quality > toxic")).alias("wins"), F.count_if(F.expr("quality < toxic")).alias("losses"))
    return s.select("source", "wins", "losses", F.round(E.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


@query("agg_31_wilson", """with s as (select source, sum(quality) as k, count(*) as n from labels join documents using (doc_id) group by source)
    select source, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) as low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) as high from s""")
def _(t):
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return s.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("agg_40_verdict", """select case when count(*) filter (status = 'dead') > 0 then 'NO_GO' when count(*) filter (status = 'in_progress') > 0 then 'GO_WITH_CONFIG' else 'GO' end as verdict, source_id from job where op <> 'view' group by source_id""")
def _(t):
    g = t.job.filter("op <> 'view'").groupBy("source_id").agg(F.bool_or(F.col("status") == "dead").alias("bad"), F.bool_or(F.col("status") == "in_progress").alias("open"))
    return g.select(F.when(F.col("bad"), "NO_GO").when(F.col("open"), "GO_WITH_CONFIG").otherwise("GO").alias("verdict"), "source_id")


@query("agg_46_load_test", """select op, count(*) as n, list_sort(list(tokens))[cast(floor(0.95 * count(*)) as bigint) + 1] as p95, count(*) filter (status = 'dead') as failed from job group by op""")
def _(t):
    p95 = E.at_rank(t.job, "op", "tokens", lambda n: F.floor(0.95 * n) + 1).select("op", F.col("tokens").alias("p95"))
    return t.job.groupBy("op").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "dead").alias("failed")).join(p95, "op").select("op", "n", "p95", "failed")


@query("agg_48_first_seen_mode", """select lang, source as mode from (select lang, source, count(*) as n, min(doc_id) as first from documents group by all) qualify row_number() over (partition by lang order by n desc, first) = 1""")
def _(t):
    g = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.groupBy("lang").agg(F.min_by("source", F.struct(-F.col("n"), F.col("first"))).alias("mode"))
