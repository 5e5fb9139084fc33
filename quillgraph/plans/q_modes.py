"""Queries of the search modes. Claims (documents as facts) have texts, vectors, sources and times; the day is 800."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import rules as R
from quillgraph.functions import strings as S
from quillgraph.functions import vectors as V
from quillgraph.operators import fulltext as FT
from quillgraph.operators import modes as M
from quillgraph.operators import retrieval as RT
from quillgraph.operators.ordered import running
from quillgraph.plans.canonical import query
from quillgraph.plans.q_retrieval import _BM25, _VEC, COS, query_vector, search_text, vectors
from quillgraph.plans.q_rules import _STEM, sql_has

_NOW = "(invalid_day is null or invalid_day > 800)"
SCOPE = ("ASIA", "EUROPE")
_LISTS = f"""{_BM25}, {_VEC}, l as (select doc_id as id, 0 as list, row_number() over (order by score desc, doc_id) as rank from (select * from bm order by score desc, doc_id limit 60)
    union all select vec_id, 1, row_number() over (order by score desc, vec_id) from (select * from vs order by score desc, vec_id limit 60)),
    f as (select id, sum(1.0 / (60 + rank)) as score, min(list * 1000 + rank) as first from l group by id),
    hit as (select id, row_number() over (order by round(score, 12) desc, first) as pos from f qualify pos <= 60)"""


def _words(t):
    return search_text(t).select(F.col("doc_id").alias("id"), "score")


def _near(t, k: int):
    return vectors(t, k).select(F.col("vec_id").alias("id"), "score")


def _scope(t, *names: str):
    return t.claim_scope.filter(F.col("vendor").isin(*names)).select("claim_id")


@query("ret_2_local_search", f"""with {_LISTS}, own as (select claim_id as id from claim join claim_scope using (claim_id) where vendor = 'ASIA' and {_NOW}),
    a as (select id, pos from hit where id in (select id from own) order by pos limit 15),
    b as (select vec_id as id, 1000000 + row_number() over (order by score desc, vec_id) as pos from vs where vec_id in (select id from own) and vec_id not in (select id from a)),
    m as (select id, row_number() over (order by pos) as pos from (select * from a union all (select * from b order by pos limit 15)))
    select pos, id as claim_id, vendor || ' · ' || product as label from m join claim_scope on claim_id = id where pos <= 15""")
def _(t):
    """Fused lists, what is current and in scope, the scope's own facts after them, with their sources."""
    whole = t.embeddings.filter("vec_id <> 0").select(F.col("vec_id").alias("id"), V.cosine_or_zero(F.col("embedding"), F.array(*map(F.lit, query_vector(t)))).alias("score"))
    found = M.local(M.fused([_words(t), _near(t, 60)], 60), t.claim, _scope(t, "ASIA"), F.expr(_NOW), 15, whole)
    labels = t.claim_scope.select(F.col("claim_id").alias("id"), F.concat("vendor", F.lit(" · "), "product").alias("label"))
    return found.join(labels, "id").select(F.col("pos").cast("long").alias("pos"), F.col("id").alias("claim_id"), "label")


@query("ret_6_timeline_search", f"""with {_BM25}, top as (select doc_id as claim_id from bm order by score desc, doc_id limit 60), sc as (select c.*, vendor from claim c join claim_scope using (claim_id) where vendor in ('ASIA', 'EUROPE') and claim_id in (select claim_id from top))
    select claim_id, row_number() over (order by valid_day nulls last, claim_id) as place, case when {_NOW} then 'current' when swept then 'expired' else 'superseded' end as status, vendor from sc qualify place <= 20""")
def _(t):
    """Three times as many facts as asked for, those in scope, in order of time, with what became of each."""
    top = _words(t).orderBy(F.desc("score"), "id").limit(60).select(F.col("id").alias("claim_id"))
    s = t.claim.join(top, "claim_id", "left_semi").join(t.claim_scope.filter(F.col("vendor").isin(*SCOPE)).select("claim_id", "vendor"), "claim_id")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("valid_day"), "claim_id")).cast("long")  # of 60 rows at most
    status = F.when(F.expr(_NOW), "current").when(F.col("swept"), "expired").otherwise("superseded")
    return s.select("claim_id", place.alias("place"), status.alias("status"), "vendor").filter("place <= 20")


@query("ret_8_keyword_sweep", f"""with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents), st as (select count(*) as docs, avg(len(w)) as mean from d), x as (select doc_id, len(w) as n, unnest(w) as term from d),
    p as (select doc_id, term, n, count(*) as tf from x where term in ('nicht', 'ertion') or starts_with(term, 'ertio') group by all), df as (select term, count(*) as df from p group by term),
    s as (select doc_id as id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from p join df using (term), st group by doc_id),
    live as (select id, score from s join claim on claim_id = id where {_NOW} order by score desc, id limit 100), own as (select live.*, vendor from live join claim_scope on claim_id = id where vendor in ('ASIA', 'EUROPE'))
    select id as claim_id, row_number() over (order by score desc, id) as pos, vendor from own qualify pos <= 20""")
def _(t):
    """Exact forms and a prefix; current facts, five times as many as asked for, those in scope, and their sources."""
    hits = FT.bm25(FT.index(t.documents, t.sf_dir), ["nicht", "ertion"], ["ertio"])
    found = M.sweep(hits, t.claim, _scope(t, *SCOPE), F.expr(_NOW), 20)
    return found.join(t.claim_scope.select(F.col("claim_id").alias("id"), "vendor"), "id").select(F.col("id").alias("claim_id"), F.col("pos").cast("long").alias("pos"), "vendor")


_COMM = f"""q as (select embedding as q from embeddings where vec_id = 0), m as (select label as community, vec_id as id, embedding, label % 2 as level, label % 10 as rating from embeddings where vec_id <> 0),
    c as (select community, any_value(level) as level, any_value(rating) as rating, arg_min(embedding, id) as e from m group by community),
    ranked as (select community, {COS.format(a='e', b='q')} + 0.1 * rating / 10 as score, (community * 37 % 100) / 100.0 as r from c, q where level = 0),
    share as (select community, avg((vendor in ('ASIA', 'EUROPE'))::int) as share from m join claim_scope on claim_id = id group by community),
    top as (select * from ranked order by score desc, community limit 12), kept as (select * from top where community in (select community from share where share >= 0.2))"""


def _communities(t):
    """Communities are labels of vectors: the first member's vector stands for the report's."""
    m = t.embeddings.filter("vec_id <> 0").select(F.col("label").alias("community"), F.col("vec_id").alias("id"), "embedding")
    c = m.groupBy("community").agg(F.min_by("embedding", "id").alias("e")).filter("community % 2 = 0")
    share = m.join(t.claim_scope, F.col("claim_id") == F.col("id")).groupBy("community").agg(F.avg(F.col("vendor").isin(*SCOPE).cast("int")).alias("share"))
    score = V.cosine_or_zero(F.col("e"), F.array(*map(F.lit, query_vector(t)))) + 0.1 * (F.col("community") % 10) / 10
    return m, c, share, score


def _shortlist(t, degraded: bool):
    _, c, share, score = _communities(t)
    r = (F.col("community") * 37 % 100) / 100.0
    return M.shortlist(c, score, share, 5, 12, 0.2, F.lit(None).cast("double") if degraded else r, 4, 0.3)


@query("ret_3_community_shortlist", f"""with {_COMM} select 'reranked' as how, community, round(score, 6) as score, row_number() over (order by r desc, score desc, community) as place from kept qualify place <= 4 and r >= 0.3
    union all select 'degraded', community, round(score, 6), row_number() over (order by score desc, community) as place from kept qualify place <= 4""")
def _(t):
    """By similarity and rating, those with enough in scope; then a reranker's best above its floor, or, where it failed,
    the order as it was."""
    one, two = (_shortlist(t, d).select(F.lit(how).alias("how"), "community", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place")) for d, how in ((False, "reranked"), (True, "degraded")))
    return one.unionByName(two)


@query("top_3_rerank_floor", """with d as (select source, vec_id, label, row_number() over (partition by source order by vec_id) as o, case when length(source) % 2 = 0 then (vec_id * 37 % 100) / 100.0 end as r from embeddings join documents on doc_id = vec_id qualify o <= 10),
    x as (select *, row_number() over (partition by source order by r desc nulls last, o) as place from d) select source, vec_id, place, r is null as degraded from x where place <= 3 and (r is null or r >= 0.5)""")
def _(t):
    """Of each candidate list the three best by rerank score that reach the floor; a list that couldn't be scored keeps its
    order, and says so. A list of which nothing reaches the floor is empty."""
    d = t.embeddings.select("vec_id", "label").join(t.documents.select(F.col("doc_id").alias("vec_id"), "source"), "vec_id")
    d = d.withColumn("o", F.row_number().over(Window.partitionBy("source").orderBy("vec_id"))).filter("o <= 10")
    d = d.withColumn("r", F.when(F.length("source") % 2 == 0, (F.col("vec_id") * 37 % 100) / 100.0))
    x = d.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("r"), "o")).cast("long"))
    return x.filter("place <= 3 and (r is null or r >= 0.5)").select("source", "vec_id", "place", F.col("r").isNull().alias("degraded"))


_MAPPED = f"""{_COMM}, short as (select community, row_number() over (order by r desc, score desc, community) as place, r from kept qualify place <= 4 and r >= 0.3),
    mapped as (select community, place, id, row_number() over (partition by community order by {COS.format(a='embedding', b='q')} desc, id) as pos from m join short using (community), q qualify pos <= 6)"""


@query("ret_4_global_search", f"""with {_MAPPED}, n as (select id, min(place * 100 + pos) as o from mapped where id in (select claim_id from claim_scope where vendor in ('ASIA', 'EUROPE')) group by id)
    select row_number() over (order by o) as number, id as claim_id, community from n join mapped using (id) where place * 100 + pos = o""")
def _(t):
    """Each community on the shortlist gives its six best facts (the seam: what a model finds in its report); those out of
    scope go, and the rest are numbered through."""
    m, *_ = _communities(t)
    near = V.cosine_or_zero(F.col("embedding"), F.array(*map(F.lit, query_vector(t))))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("near"), "id"))
    mapped = m.join(_shortlist(t, False).select("community", "place"), "community").withColumn("near", near).withColumn("pos", rank).filter("pos <= 6")
    return M.numbered_facts(mapped.select("community", "place", "id", "pos"), _scope(t, *SCOPE)).select(F.col("number").cast("long").alias("number"), F.col("id").alias("claim_id"), "community")


@query("ret_5_drift_search", f"""with {_COMM}, short as (select community, row_number() over (order by score desc, community) as place from ranked qualify place <= 3),
    lead as (select community, place, id as lead, embedding as le from m join short using (community) join q on true qualify row_number() over (partition by community order by {COS.format(a='embedding', b='q')} desc, id) = 1),
    found as (select place, x.vec_id as id, row_number() over (partition by place order by {COS.format(a='x.embedding', b='le')} desc, x.vec_id) as pos from lead join embeddings x on x.vec_id <> lead join claim on claim_id = x.vec_id join claim_scope using (claim_id) where {_NOW} and vendor in ('ASIA', 'EUROPE') qualify pos <= 8),
    n as (select id, min(place * 100 + pos) as o from found group by id) select id as claim_id, row_number() over (order by o) as number from n""")
def _(t):
    """Communities prime further questions (each its leading member's vector), which are searched in scope; facts that
    come again count once."""
    m, c, _, score = _communities(t)
    short = M.shortlist(c, score, None, 3, 3, 0.0)
    near = V.cosine_or_zero(F.col("embedding"), F.array(*map(F.lit, query_vector(t))))
    lead = m.join(short.select("community", "place"), "community").withColumn("near", near).groupBy("place").agg(F.min_by(F.struct("id", "embedding"), F.struct(-F.col("near"), F.col("id"))).alias("m"))
    own = t.claim.filter(F.expr(_NOW)).join(_scope(t, *SCOPE), "claim_id", "left_semi").select(F.col("claim_id").alias("vec_id"))
    asked = lead.select(F.col("m.id").alias("vec_id"), F.col("m.embedding").alias("embedding"))
    found = RT.vector_join(asked, t.embeddings.join(own, "vec_id", "left_semi"), 8).join(lead.select(F.col("m.id").alias("query_id"), "place"), "query_id")
    first = found.groupBy("id").agg(F.min(F.struct("place", "rank")).alias("o"))
    return first.select(F.col("id").alias("claim_id"), F.row_number().over(Window.orderBy("o")).cast("long").alias("number"))  # of 24 rows at most


@query("ret_7_list_search")
def _(t):
    """The question and one expansion, keywords, siblings, two collapses, limitations apart, a diverse choice."""
    scope = _scope(t, "ASIA", "EUROPE", "AMERICA")
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    own = M.local(M.fused([_words(t), _near(t, 60)], 60), t.claim, scope, F.expr(_NOW), 40)
    expansion = FT.bm25(FT.index(t.documents, t.sf_dir), ["the", "nicht"])
    other = M.local(M.fused([expansion], 60), t.claim, scope, F.expr(_NOW), 40)
    keywords = M.sweep(_words(t), t.claim, scope, F.expr(_NOW), 30)
    scores = t.claim.filter("claim_id % 13 <> 0").select(F.col("claim_id").alias("id"), ((F.col("claim_id") * 31 % 100) / 100.0).alias("score"))
    return M.list_search([own, other, keywords], t.claim, v, scores, scope, F.expr(_NOW))


@query("ret_9_enumerate_vendors", f"""with x as (select vendor, claim_id, text, case when vendor <> 'AFRICA' then (claim_id % 100) / 100.0 end as score from claim join claim_scope using (claim_id) where {_NOW}),
    own as (select * from (select * from x qualify row_number() over (partition by vendor order by score desc nulls last, claim_id) <= 10) where not {sql_has('text', R.LIMITATION)}), g as (select vendor, count(*) as facts, max(score) as best from own group by vendor)
    select vendor, facts, best, case when best is null then 'unchecked' when best >= 0.985 then 'documented' else 'weak' end as state from g""")
def _(t):
    x = t.claim.filter(F.expr(_NOW)).join(t.claim_scope.select("claim_id", "vendor"), "claim_id")
    return M.vendors(x.select("vendor", F.col("claim_id").alias("id"), "text", F.when(F.col("vendor") != "AFRICA", (F.col("claim_id") % 100) / 100.0).alias("score")), 10, 0.985)


_THREE = "^[^a-z0-9]*+[a-z0-9]++[^a-z0-9]++([a-z0-9]++)[^a-z0-9]++([a-z0-9]++)"
_HAS = "len(list_filter({ws}, lambda w: case when length({s}) < 4 then w = {s} or w = {s} || 's' else starts_with(w, {s}) or (ends_with({s}, 'y') and starts_with(w, left({s}, length({s}) - 1) || 'ie')) end)) > 0"


@query("ret_10_item_grades", f"""with f as (select claim_id as id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as ws, {sql_has('text', R.LIMITATION)} as limitation, case when claim_id % 13 <> 0 then (claim_id * 31 % 100) / 100.0 end as score from claim),
    l as (select doc_id as line, regexp_extract_all(lower(text), '[a-z0-9]+')[2:3] as item, case doc_id % 3 when 0 then ['the'] when 1 then []::varchar[] else ['nicht', 'der'] end as terms, case when doc_id % 9 = 0 then []::bigint[] else [doc_id, doc_id + 1, doc_id * 7 % 100] end as ms from documents where len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 3),
    m as (select line, item, terms, unnest(ms) as id, generate_subscripts(ms, 1) as pos from l), i as (select line, item, pos, id, unnest(item) as w from m), si as (select line, pos, id, {_STEM.format(w='w')} as s from i),
    ni as (select line, pos, count(*) filter ({_HAS.format(ws='ws', s='s')}) * 2 >= count(*) as half from si join f using (id) group by all),
    te as (select line, pos, id, unnest(terms) as w from m), st as (select line, pos, id, w, {_STEM.format(w='w')} as s from te), mi as (select line, pos, list(w) filter (not ({_HAS.format(ws='ws', s='s')})) as missing from st join f using (id) group by all),
    x as (select m.line, m.pos, f.id is not null and not limitation as there, coalesce(f.id is not null and not limitation and (score is null or score >= 0.3) and half, false) as named, coalesce(missing, []) as missing, coalesce(score >= 0.1, false) as near from m left join f using (id) left join ni using (line, pos) left join mi using (line, pos)),
    g as (select line, bool_or(there) as there, bool_or(named and len(missing) = 0) as confirmed, bool_or(named) as named, bool_or(there and near) as near, min(pos) filter (named) as first from x group by line),
    h as (select l.line, coalesce(there, false) as there, coalesce(confirmed, false) as confirmed, coalesce(named, false) as named, coalesce(near, false) as near, first from l left join g using (line))
    select line, case when confirmed then 'confirmed' when named or near then 'needs_validation' else 'dropped' end as grade, case when confirmed then 'named' when named then 'missing_terms' when not there then 'no_marker' when near then 'unnamed' else 'below_floor' end as reason,
      case when named and not confirmed then (select array_to_string(list_sort(missing), ' ') from x where x.line = h.line and x.pos = h.first) else '' end as missing from h""")  # fmt: skip
def _(t):
    w = S.tokens(F.coalesce("text", F.lit("")))
    facts = t.claim.select(F.col("claim_id").alias("id"), F.array_distinct(w).alias("words"), R.is_limitation(F.col("text")).alias("limitation"), F.when(F.col("claim_id") % 13 != 0, (F.col("claim_id") * 31 % 100) / 100.0).alias("score"))
    none = F.array().cast("array<string>")
    terms = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("the"))).when(F.col("doc_id") % 3 == 1, none).otherwise(F.array(F.lit("der"), F.lit("nicht")))
    markers = F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") * 7 % 100))
    # Of a text's words the second and the third; the others are not cut out.
    item = F.array(*[F.regexp_extract(F.lower("text"), _THREE, i) for i in (1, 2)])
    lines = t.documents.filter(F.lower("text").rlike(_THREE)).select(F.col("doc_id").alias("line"), item.alias("words"), terms.alias("terms"), markers.alias("markers"))
    return M.grade_items(lines, facts, 0.3, 0.1)


@query("ret_14_report_context", """with d as (select src as entity_id, count(*) as n from fact group by src), m as (select label, entity_id from d join entity using (entity_id) qualify row_number() over (partition by label order by n desc, entity_id) <= 30),
    r as (select label, fact_id, src, length(relation) + length(cast(fact_id as varchar)) + 4 as chars, row_number() over (partition by src order by valid_at desc, fact_id) as depth from fact join m on entity_id = src),
    s as (select label, fact_id, chars, sum(chars) over (partition by label order by depth, src rows unbounded preceding) as used, row_number() over (partition by label order by depth, src) as place from r)
    select label, fact_id, place from s where used <= 400 or place = 1""")
def _(t):
    """Facts of a community's thirty members of highest degree, these taking turns and the latest first, while the lines
    fit the budget; one in any case."""
    d = t.fact.groupBy(F.col("src").alias("entity_id")).agg(F.count("*").alias("n")).join(t.entity.select("entity_id", "label"), "entity_id")
    m = d.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "entity_id"))).filter("rn <= 30").select(F.col("entity_id").alias("src"), "label")
    depth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("valid_at"), "fact_id"))
    chars = F.length("relation") + F.length(F.col("fact_id").cast("string")) + 4
    r = t.fact.join(m, "src").select("label", "fact_id", "src", chars.alias("chars"), depth.alias("depth"))
    s = running(r, ["label"], [F.col("depth"), F.col("src")], F.col("chars"))
    return s.filter((F.col("before") + F.col("chars") <= 400) | (F.col("place") == 1)).select("label", "fact_id", "place")


@query("agg_19_worst_cosine", f"""with e as (select vec_id, embedding, md5(text) as h from embeddings join documents on doc_id = vec_id) select a.h, round(min({COS.format(a='a.embedding', b='b.embedding')}), 6) as worst from e a join e b on a.h = b.h and a.vec_id < b.vec_id group by a.h""")
def _(t):
    """The least similar pair of each group of copies, as a merge plan has them: blocks of rows are multiplied as
    matrices, and no pair is a row."""
    e = t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("h")), "vec_id").select("h", F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return RT.worst_cosine(e, "h").select("h", F.round("worst", 6).alias("worst"))
