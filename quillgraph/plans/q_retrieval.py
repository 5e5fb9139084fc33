"""Search queries: BM25, vectors, fusion, reranking, near duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors as V
from quillgraph.operators import dedup as D
from quillgraph.operators import fulltext as FT
from quillgraph.operators import retrieval as R
from quillgraph.plans.canonical import query

TERMS = ["the", "ertion", "nicht"]
#: Cosine of e.embedding with q.embedding in doubles.
COS = """(list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))
  / sqrt(list_sum(list_transform({a}, lambda z: z::double * z::double)) * list_sum(list_transform({b}, lambda z: z::double * z::double))))"""
_BM25 = (
    """w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as w from documents), c as (select doc_id, len(w) as n, """
    + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) as t{i}" for i, t in enumerate(TERMS))
    + " from w), s as (select count(*) as docs, avg(n) as mean, "
    + ", ".join(f"count(*) filter (t{i} > 0) as d{i}" for i in range(len(TERMS)))
    + " from c), bm as (select doc_id, "
    + " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(TERMS)))
    + " as score from c, s where "
    + " or ".join(f"t{i} > 0" for i in range(len(TERMS)))
    + ")"
)
_VEC = f"q as (select embedding as q from embeddings where vec_id = 0), vs as (select vec_id, {COS.format(a='embedding', b='q')} as score from embeddings, q where vec_id <> 0)"


def search_text(t, terms: list[str] = TERMS):
    """BM25 over the postings of documents: doc_id, score."""
    return FT.bm25(FT.index(t.documents, t.sf_dir), terms).withColumnRenamed("id", "doc_id")


def query_vector(t) -> list[float]:
    """The stored vector that stands for an embedded question."""
    return [float(x) for x in t.embeddings.filter("vec_id = 0").select("embedding").first()[0]]


def vectors(t, k: int):
    return R.vector_search(t.embeddings.filter("vec_id <> 0"), query_vector(t), k)


@query("fts_bm25_top", f"with {_BM25} select doc_id, round(score, 6) as score from bm order by score desc, doc_id limit 50")
def _(t):
    return FT.bm25_top(FT.index(t.documents, t.sf_dir), TERMS, 50).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("top_1_cosine", f"with {_VEC} select vec_id, round(score, 6) as score from vs order by score desc, vec_id limit 20")
def _(t):
    return vectors(t, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("ret_1_hybrid_search", f"""with {_BM25}, {_VEC}, l as (select doc_id as id, 1 as list, row_number() over (order by score desc, doc_id) as rank from (select * from bm order by score desc, doc_id limit 50)
    union all select vec_id, 2, row_number() over (order by score desc, vec_id) from (select * from vs order by score desc, vec_id limit 50)),
    f as (select id, sum(1.0 / (60 + rank)) as score, min(list * 1000 + rank) as first from l group by id)
    select id as doc_id, round(score, 9) as score, row_number() over (order by round(score, 12) desc, first) as rank, source from f join documents on doc_id = id qualify rank <= 10""")  # fmt: skip
def hybrid_search(t):
    """BM25 and vector lists of 50, fused by reciprocal ranks; the ten best with their source."""
    lists = R.ranked(search_text(t), "doc_id", 1, 50).unionByName(R.ranked(vectors(t, 50), "vec_id", 2, 50))
    fused = R.rrf(lists).withColumnRenamed("id", "doc_id")
    place = F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "first")).cast("long")  # of 100 rows at most
    best = fused.join(t.documents.select("doc_id", "source"), "doc_id").withColumn("rank", place)
    return best.filter("rank <= 10").select("doc_id", F.round("score", 9).alias("score"), "rank", "source")


@query("win_2_rrf", """with l as (select p_partkey as id, 1 as list, row_number() over (order by p_retailprice desc, p_partkey) as rank from part qualify rank <= 100
    union all select p_partkey, 2, row_number() over (order by p_size desc, p_partkey) from part qualify row_number() over (order by p_size desc, p_partkey) <= 100)
    select id, round(sum(1.0 / (60 + rank)), 9) as score from l group by id""")  # fmt: skip
def _(t):
    one = R.ranked(t.part.select("p_partkey", F.col("p_retailprice").alias("score")), "p_partkey", 1, 100)
    two = R.ranked(t.part.select("p_partkey", F.col("p_size").alias("score")), "p_partkey", 2, 100)
    return R.rrf(one.unionByName(two)).select("id", F.round("score", 9).alias("score"))


@query("join_13_vector_join", f"""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as id, {COS.format(a='embedding', b='q')} as score from embeddings, q where vec_id <> query_id)
    select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10""")  # fmt: skip
def _(t):
    return R.vector_join(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 10).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vec_quantise", """with m as (select vec_id, embedding as e, list_max(list_transform(embedding, lambda x: abs(x)))::double as top from embeddings)
    select vec_id, array_to_string(list_transform(e, lambda x: round(x::double * 127 / top)::int), ',') as q from m""")
def _(t):
    return t.embeddings.select("vec_id", F.array_join(F.transform(V.quantise(F.col("embedding")), lambda x: x.cast("string")), ",").alias("q"))


@query("vec_unit_score", f"with {_VEC} select vec_id, round((1 + score) / 2, 6) as score from vs where score > 0")
def _(t):
    scored = R.scored(t.embeddings.filter("vec_id <> 0"), query_vector(t))
    return scored.filter("score > 0").select("vec_id", F.round(V.unit_score(F.col("score")), 6).alias("score"))


@query("agg_49_nearest_neighbours", f"""with s as (select a.vec_id, max({COS.format(a='a.embedding', b='b.embedding')}) as near from embeddings a, embeddings b where a.vec_id <> b.vec_id and a.vec_id % 20 = 0 group by a.vec_id)
    select round(percentile_disc(0.1) within group (order by near), 6) as p10, round(percentile_disc(0.5) within group (order by near), 6) as p50, round(percentile_disc(0.9) within group (order by near), 6) as p90 from s""")
def _(t):
    near = R.vector_join(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 1)
    return near.agg(*[F.round(F.expr(f"percentile_disc({q}) within group (order by score)"), 6).alias(f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9)])


@query("agg_32_recall_at_10", f"""with q as (select vec_id as query_id, embedding as q, label as ql from embeddings where vec_id % 20 = 0),
    s as (select query_id, vec_id as id, label = ql as same, {COS.format(a='embedding', b='q')} as score from embeddings, q where vec_id <> query_id),
    exact as (select query_id, id from s qualify row_number() over (partition by query_id order by score desc, id) <= 10),
    cell as (select query_id, id from s where same qualify row_number() over (partition by query_id order by score desc, id) <= 10)
    select query_id, (select count(*) from cell c join exact e using (query_id, id) where c.query_id = q.query_id) / 10.0 as recall from q""")
def _(t):
    """Recall of a search within the query's own cell (its label) against the exact one."""
    q, e = t.embeddings.filter("vec_id % 20 = 0"), t.embeddings
    exact = R.vector_join(q, e, 10).select("query_id", "id")
    cell = R.vector_join(q, e, 10, group_col="label").select("query_id", "id")
    both = cell.join(exact, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("n"))
    return q.select(F.col("vec_id").alias("query_id")).join(both, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / 10.0).alias("recall"))


@query("top_2_boosted_rank", f"with {_VEC} select vec_id, round(score + 0.1 * (label % 10) / 10, 6) as boosted from vs join embeddings using (vec_id) where label <> 0 order by score + 0.1 * (label % 10) / 10 desc, vec_id limit 25")
def _(t):
    scored = t.embeddings.filter("vec_id <> 0 and label <> 0").select("vec_id", (V.cosine_or_zero(F.col("embedding"), F.array(*map(F.lit, query_vector(t)))) + 0.1 * (F.col("label") % 10) / 10).alias("b"))
    return scored.orderBy(F.desc("b"), "vec_id").limit(25).select("vec_id", F.round("b", 6).alias("boosted"))


@query("top_4_padded_rerank", f"""with {_VEC}, c as (select vec_id, score, row_number() over (order by score desc, vec_id) as pos, case when vec_id % 2 = 0 then score * score end as r from vs qualify pos <= 30)
    select vec_id, pos, row_number() over (order by r is null, r desc, pos) as place from c qualify place <= 20""")
def _(t):
    pos = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long")  # of 30 rows
    c = vectors(t, 30).withColumn("pos", pos).withColumn("r", F.when(F.col("vec_id") % 2 == 0, F.col("score") * F.col("score")))
    place = F.row_number().over(Window.orderBy(F.col("r").isNull(), F.desc("r"), "pos")).cast("long")
    return c.withColumn("place", place).filter("place <= 20").select("vec_id", "pos", "place")


@query("top_6_diverse_selection")
def _(t):
    near = R.vector_join(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 40)
    hits = near.join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    return R.diverse(hits.select("query_id", "id", "score", "v"), 10)


@query("join_15_near_duplicate_collapse")
def _(t):
    """Within a vendor (here a source's number) facts of the same text or a cosine from 0.9 on are one, the first; it has
    the languages of all."""
    d = t.documents.select(F.col("doc_id").alias("vec_id"), F.expr("cast(substring(source, 4) as int)").alias("vendor"), "lang", "text")
    items = t.embeddings.join(d, "vec_id").select("vendor", F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "text", "lang")
    kept = D.collapse_near_duplicates(items, "vendor", 0.9, text_col="text")
    merged = kept.join(items.select("id", "lang"), "id").groupBy("vendor", "kept").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"), F.count("*").alias("facts"))
    return merged.select("vendor", F.col("kept").alias("id"), "facts", "langs")


@query("agg_33_first_hit_rank", f"""with q as (select vec_id as query_id, embedding as q, label as ql from embeddings where vec_id % 20 = 0),
    s as (select query_id, label = ql as hit, row_number() over (partition by query_id order by {COS.format(a='embedding', b='q')} desc, vec_id) as rank from embeddings, q where vec_id <> query_id qualify rank <= 10)
    select query_id, count(*) filter (hit) / 10.0 as precision, round(coalesce(1.0 / min(rank) filter (hit), 0), 6) as reciprocal from s group by query_id""")
def _(t):
    e = t.embeddings.select("vec_id", "label")
    near = R.vector_join(t.embeddings.filter("vec_id % 20 = 0"), t.embeddings, 10)
    hit = near.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("a")), "id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id")
    first = F.min(F.when(F.col("a") == F.col("b"), F.col("rank")))
    return hit.groupBy("query_id").agg((F.count_if(F.col("a") == F.col("b")) / 10.0).alias("precision"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 6).alias("reciprocal"))
