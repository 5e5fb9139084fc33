"""Graph queries: projection, communities, cleanup, merging, sweeps, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import rules as R
from quillgraph.operators import dedup as D
from quillgraph.operators import graphs as G
from quillgraph.operators import provenance as P
from quillgraph.plans.canonical import AS_OF, now, query
from quillgraph.plans.q_rules import sql_has

#: Two layers of communities: entities by label, and as they would be after a change.
FRESH = "select 0 as level, p_brand as community, p_partkey as node from part where p_size <> 7"
KEPT = "select 0 as level, case when p_size > 45 then 'moved' else p_brand end as community, p_partkey as node from part where p_size <> 9"


def _layer(t, size_rule: bool, without: int):
    label = F.when(F.col("p_size") > 45, "moved").otherwise(F.col("p_brand")) if size_rule else F.col("p_brand")
    return t.part.filter(F.col("p_size") != without).select(F.lit(0).alias("level"), label.alias("community"), F.col("p_partkey").alias("node"))


def _fresh(t):
    return _layer(t, False, 7)


def _kept(t):
    return _layer(t, True, 9)


def _edges(t):
    """Ends of facts, which are read once."""
    return t.made("fact").select("src", "dst")


@query("gr_1_projection", "select least(src, dst) as a, greatest(src, dst) as b, count(*) as weight from fact where src <> dst group by 1, 2")
def _(t):
    return G.undirected(_edges(t))


@query("gr_1_degrees", """with p as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as w from fact where src <> dst group by 1, 2)
    select node, count(*) as degree, cast(sum(w) as bigint) as strength from (select a as node, w from p union all select b, w from p) group by node""")
def _(t):
    return G.degrees(G.undirected(_edges(t)))


@query("gr_2_communities")
def _(t):
    return G.communities(_edges(t), levels=2)


@query("gr_3_hierarchy", """with l as (select 0 as level, p_brand as community, p_partkey as node from part union all select 1, substr(p_brand, 1, 7), p_partkey from part)
    select a.level, a.community, min(b.community) as parent, count(*) as members, substr(sha1(a.level || ':' || string_agg(cast(a.node as varchar), ',' order by cast(a.node as varchar))), 1, 16) as id
    from l a left join l b on b.node = a.node and b.level = a.level + 1 group by a.level, a.community""")
def _(t):
    low = t.part.select(F.col("p_partkey").alias("node"), F.lit(0).alias("level"), F.col("p_brand").alias("community"))
    up = t.part.select(F.col("p_partkey").alias("node"), F.lit(1).alias("level"), F.substring("p_brand", 1, 7).alias("community"))
    return G.hierarchy(low.unionByName(up))


@query("join_12_jaccard_pairs", f"""with f as ({FRESH}), k as ({KEPT}), b as (select f.level, f.community as c, k.community as d, count(*) as n from f join k using (node) group by all),
    j as (select level, c, d, n * 1.0 / ((select count(*) from f where community = c) + (select count(*) from k where community = d) - n) as j from b)
    select level, c as fresh, d as kept, round(j, 6) as jaccard from j where j >= 0.3""")
def _(t):
    return G.jaccard_pairs(_fresh(t), _kept(t), 0.3).withColumn("jaccard", F.round("jaccard", 6))


@query("join_12_matching")
def _(t):
    return G.match_communities(_fresh(t), _kept(t), 0.3)


@query("gr_5_node_distance", """with recursive e as (select src as u, dst as v from fact union select dst, src from fact), w(node, d) as (select (select min(u) from e), 0 union select v, d + 1 from w join e on u = node where d < 3)
    select node, min(d) as distance from w group by node""")
def _(t):
    edges = t.fact.select("src", "dst")
    centre = edges.agg(F.least(F.min("src"), F.min("dst"))).first()[0]
    return G.distances(edges, centre)


@query("gr_7_merge_plan", """with g as (select label || kind as k, entity_id, row_number() over (partition by label || kind order by size nulls last, price, entity_id) as rn, count(*) over (partition by label || kind) as n from entity)
    select entity_id, min(entity_id) filter (rn = 1) over (partition by k) as survivor, n as copies from g where n > 1""")
def _(t):
    keyed = t.entity.withColumn("k", F.concat("label", "kind"))
    return D.merge_plan(keyed, "k", [F.col("size").isNull(), F.col("size"), F.col("price")])


@query("join_16_exact_name_groups", "select md5(text) as h, count(*) as copies, min(doc_id) as first from documents group by text having count(*) > 1")
def _(t):
    return t.documents.groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


@query("agg_18_near_names", """select lower(trim(n)) as key, count(distinct n) as spellings from (select case when doc_id % 2 = 0 then upper(source) else source || ' ' end as n from documents) group by 1 having count(distinct n) > 1""")
def _(t):
    names = t.documents.select(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat("source", F.lit(" "))).alias("name"))
    return D.near_names(names)


@query("gr_8_label_promotion", """with g as (select size, count(distinct label) filter (price > 1400) as n, min(label) filter (price > 1400) as l, min(entity_id) as survivor, bool_or(price <= 1400) as bare from entity group by size)
    select size, survivor, case when bare and n = 1 then l end as promoted from g""")
def _(t):
    typed = F.when(F.col("price") > 1400, F.col("label"))
    g = t.entity.groupBy("size").agg(F.count_distinct(typed).alias("n"), F.min(typed).alias("l"), F.min("entity_id").alias("survivor"), F.bool_or(F.col("price") <= 1400).alias("bare"))
    return g.select("size", "survivor", F.when(F.col("bare") & (F.col("n") == 1), F.col("l")).alias("promoted"))


@query("gr_11_navigation_tombstone", f"select episode_id, superseded or article_id in (select article_id from page_title where {sql_has('title', R.NAVIGATION)}) as removed from episode")
def _(t):
    """Episodes of navigation pages go."""
    nav = t.page_title.filter(R.is_navigation(F.col("title"))).select("article_id", F.lit(True).alias("nav"))
    return t.episode.join(nav, "article_id", "left").select("episode_id", (F.col("superseded") | F.coalesce("nav", F.lit(False))).alias("removed"))


@query("gr_12_staleness_sweep", f"""with s as (select e.episode_id, (not coalesce(superseded, false) and not coalesce(removed, false)) as alive, died_at from episode e left join article a on a.article_id = e.article_id),
    x as (select fact_id, count(*) as episodes, count(*) filter (alive) as alive, max(died_at) as died from fact join fact_episode using (fact_id) left join s using (episode_id) where invalid_at is null group by fact_id)
    select fact_id, episodes, coalesce(died, timestamp '{AS_OF}') as invalid_at from x where alive = 0""")
def _(t):
    return P.staleness_sweep(t.fact, t.fact_episode, t.episode, t.article, now())


@query("gr_14_layer_counts", f"""with f as (select community, count(*) as n from ({FRESH}) group by all), k as (select community, count(*) as n from ({KEPT}) group by all)
    select case when k.community is null then 'written' when f.community is null then 'lost' else 'preserved' end as state, count(*) as communities from f full outer join k on f.community = k.community group by 1""")
def _(t):
    f, k = _fresh(t).select("community").distinct().withColumn("f", F.lit(1)), _kept(t).select("community").distinct().withColumn("k", F.lit(1))
    state = F.when(F.col("k").isNull(), "written").when(F.col("f").isNull(), "lost").otherwise("preserved")
    return f.join(k, "community", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("communities"))


@query("set_2_ordered_union", "select id, min(pos) as pos from (select p_partkey as id, p_size as pos from part where p_size < 10 union all select p_partkey, 100 + p_size from part where p_retailprice > 1500) group by id")
def _(t):
    a = t.part.filter("p_size < 10").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("pos"))
    b = t.part.filter("p_retailprice > 1500").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100).alias("pos"))
    return a.unionByName(b).groupBy("id").agg(F.min("pos").alias("pos"))


@query("set_3_touched_entities", f"""select entity_id from entity where price > 1800 union select src from fact where valid_at > timestamp '2000-01-01' union select dst from fact where invalid_at > timestamp '{AS_OF}'""")
def _(t):
    new = t.fact.filter(F.col("valid_at") > F.expr("timestamp_ntz'2000-01-01 00:00:00'")).select(F.col("src").alias("entity_id"))
    swept = t.fact.filter(F.col("invalid_at") > now()).select(F.col("dst").alias("entity_id"))
    return t.entity.filter("price > 1800").select("entity_id").unionByName(new).unionByName(swept).distinct()


@query("set_4_difference", "select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def _(t):
    return t.part.select("p_partkey").join(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("set_5_intersection", "select distinct src from fact intersect select dst from fact")
def _(t):
    return t.fact.select("src").distinct().join(t.fact.select(F.col("dst").alias("src")), "src", "left_semi")


@query("set_6_disjoint", "select count(*) = 0 as disjoint from (select p_partkey from part where p_size < 5 intersect select p_partkey from part where p_size > 40)")
def _(t):
    return t.part.filter("p_size < 5").join(t.part.filter("p_size > 40").select("p_partkey"), "p_partkey", "left_semi").agg((F.count("*") == 0).alias("disjoint"))


@query("str_community_id", "select p_brand, substr(sha1('2:' || string_agg(cast(p_partkey as varchar), ',' order by cast(p_partkey as varchar))), 1, 16) as id from part group by p_brand")
def _(t):
    members = t.part.select(F.lit(2).alias("level"), F.col("p_brand").alias("community"), F.col("p_partkey").alias("node"))
    return G.community_ids(members, "level", "community", "node").select(F.col("community").alias("p_brand"), "id")
