"""Search over facts with sources: local, by keywords, along time, over communities, by vendor, and for lists.

What a model does in them is a seam: a table or column that the caller gives (rerank scores, further questions, what a
report says). Lists that are cut to a number of rows are what these searches return; they are small from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import rules
from quillgraph.operators import dedup, retrieval
from quillgraph.session import cut


def fused(lists: list[DataFrame], fetch: int) -> DataFrame:
    """id, score, pos of the `fetch` best over ranked lists (id, score), by reciprocal ranks."""
    ranks = None
    for n, hits in enumerate(lists):
        one = retrieval.ranked(hits, "id", n, fetch)
        ranks = one if ranks is None else ranks.unionByName(one)
    best = retrieval.rrf(ranks).limit(fetch)
    return cut(best.select("id", "score", F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "first")).alias("pos")))  # of `fetch` rows


def _among(rows: DataFrame, few: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with an id of a list that was cut. The list goes to the rows: what a checkpoint believes of its size would
    let the rows be shuffled, texts and vectors with them."""
    return rows.join(F.broadcast(few.select(F.col("id").alias(id_col))), id_col, "left_semi")


def _current(few: DataFrame, claims: DataFrame, in_scope: DataFrame | None, current: Column) -> DataFrame:
    """Those of a list that was cut (id and more) that are current and in scope."""
    out = few.join(F.broadcast(_among(claims.filter(current).select(F.col("claim_id").alias("id")), few)), "id", "left_semi")
    if in_scope is None:
        return out
    return out.join(F.broadcast(_among(in_scope.select(F.col("claim_id").alias("id")), few)), "id", "left_semi")


def local(hits: DataFrame, claims: DataFrame, in_scope: DataFrame | None, current: Column, target: int, by_vector: DataFrame | None = None) -> DataFrame:
    """id, pos: the first `target` hits (id, pos) that are current and in scope; if they are fewer, the scope's own
    current facts by similarity (`by_vector`: id, score) after them."""
    kept = cut(_current(hits, claims, in_scope, current).orderBy("pos").limit(target).select("id", "pos"))
    if in_scope is None or by_vector is None:
        return _numbered(kept)
    own = claims.filter(current).select(F.col("claim_id").alias("id")).join(in_scope.select(F.col("claim_id").alias("id")), "id", "left_semi")
    more = by_vector.join(F.broadcast(kept.select("id")), "id", "left_anti").join(own, "id", "left_semi").orderBy(F.desc("score"), "id").limit(target)
    after = F.row_number().over(Window.orderBy(F.desc("score"), "id")) + 1_000_000  # of `target` rows
    return cut(_numbered(kept.unionByName(more.select("id", after.alias("pos")))).filter(F.col("pos") <= target))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.row_number().over(Window.orderBy("pos")).alias("pos"))  # of a list that was cut


def sweep(hits: DataFrame, claims: DataFrame, in_scope: DataFrame | None, current: Column, cap: int, overfetch: int = 5) -> DataFrame:
    """id, pos: the `cap` best hits (id, score) by keywords that are current and in scope, of `overfetch` times as many."""
    live = hits.join(claims.filter(current).select(F.col("claim_id").alias("id")), "id", "left_semi")
    top = live.orderBy(F.desc("score"), "id").limit(cap * (overfetch if in_scope is not None else 1))
    if in_scope is not None:
        top = cut(top)
        top = top.join(F.broadcast(_among(in_scope.select(F.col("claim_id").alias("id")), top)), "id", "left_semi").orderBy(F.desc("score"), "id").limit(cap)
    return cut(top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("pos")))  # of `cap` rows


def shortlist(communities: DataFrame, score: Column, shares: DataFrame | None, k: int, pool: int, min_share: float, rerank: Column | None = None, top_n: int | None = None, floor: float = 0.0) -> DataFrame:
    """community, score, place: the best communities that cite anything. With shares (community, share), those with too
    little of their facts in scope go from the pool first. rerank: scores that may all be null (the reranker failed: the
    order stays, degraded), else the `top_n` best of them that reach the floor."""
    ranked = communities.withColumn("score", score)
    top = ranked.orderBy(F.desc("score"), "community").limit(pool if shares is not None or rerank is not None else k)
    top = cut(top)
    if shares is not None:
        top = top.join(shares.filter(F.col("share") >= min_share).select("community"), "community", "left_semi")
    by_score = Window.orderBy(F.desc("score"), "community")  # of `pool` rows
    if rerank is None:
        return top.select("community", "score", F.row_number().over(by_score).alias("place"), F.lit(False).alias("degraded")).filter(F.col("place") <= k)
    n = top_n or k
    x = top.withColumn("r", rerank).withColumn("any", F.max(F.col("r").isNotNull()).over(Window.partitionBy(F.lit(1))))
    order = Window.orderBy(F.when(F.col("any"), F.col("r")).desc_nulls_last(), F.desc("score"), "community")
    x = x.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= n) & (~F.col("any") | (F.col("r") >= floor)))
    return x.select("community", "score", "place", (~F.col("any")).alias("degraded"))


def numbered_facts(mapped: DataFrame, in_scope: DataFrame | None) -> DataFrame:
    """number, community, id: the facts that communities' answers rest on (mapped: community, place, id, pos), less those
    out of scope; each once, in order of communities and facts. Communities that lose all are out."""
    kept = mapped if in_scope is None else mapped.join(in_scope.select(F.col("claim_id").alias("id")), "id", "left_semi")
    first = kept.groupBy("id").agg(F.min(F.struct("place", "pos", "community")).alias("f"))
    return first.select(F.row_number().over(Window.orderBy("f.place", "f.pos")).alias("number"), F.col("f.community").alias("community"), "id")  # of a few communities' facts


def vendors(facts: DataFrame, top: int, floor: float) -> DataFrame:
    """vendor, facts, best, state. facts: vendor, id, score, text. Of each vendor's best facts those that state no
    limitation support it; `weak` if the best scored one misses the floor, `unchecked` if none is scored."""
    rank = F.row_number().over(Window.partitionBy("vendor").orderBy(F.desc_nulls_last("score"), "id"))
    own = facts.withColumn("rn", rank).filter(F.col("rn") <= top).filter(~rules.is_limitation(F.col("text")))
    g = own.groupBy("vendor").agg(F.count("*").alias("facts"), F.max("score").alias("best"))
    return g.withColumn("state", F.when(F.col("best").isNull(), "unchecked").when(F.col("best") >= floor, "documented").otherwise("weak"))


def siblings(seeds: DataFrame, claims: DataFrame, in_scope: DataFrame | None, current: Column, groups: int, per_group: int, most: int) -> DataFrame:
    """id: other facts of the (subject, relation) groups that the seeds (id) name most."""
    top = _among(claims, seeds, "claim_id").groupBy("subject", "relation").agg(F.count("*").alias("n"))
    top = top.orderBy(F.desc("n"), "subject", "relation").limit(groups).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "subject", "relation"))).drop("n")
    own = claims.filter(current).join(F.broadcast(top), ["subject", "relation"])  # a few groups
    if in_scope is not None:
        own = own.join(in_scope.select("claim_id"), "claim_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("rank").orderBy("claim_id"))
    own = own.withColumn("rn", place).filter(F.col("rn") <= per_group).join(F.broadcast(seeds.select(F.col("id").alias("claim_id"))), "claim_id", "left_anti")
    return own.orderBy("rank", "claim_id").limit(most).select(F.col("claim_id").alias("id"))


def list_search(found: list[DataFrame], claims: DataFrame, vectors: DataFrame, scores: DataFrame, in_scope: DataFrame | None, current: Column, k: int = 10, limits: int = 5, cosine: float = 0.96, weight: float = 0.5) -> DataFrame:
    """id, place, kind (`supported` or `limitation`) for a list question.

    found: searches (id, pos) of the question and its expansions, then of keywords; scores: id, score of a reranker. Facts
    are merged in order and near duplicates collapsed; siblings of the best come in and are collapsed again; what states
    a limitation is set apart; of the rest a diverse choice is made, by score less `weight` times the similarity to what
    was chosen.
    """
    merged = None
    for n, one in enumerate(found):
        part = one.select("id", F.struct(F.lit(n).alias("list"), "pos").alias("at"))
        merged = part if merged is None else merged.unionByName(part)
    merged = cut(merged.groupBy("id").agg(F.min("at").alias("at")))
    order = F.row_number().over(Window.orderBy("at"))  # of some lists that were cut
    first = _collapsed(merged.select("id", order.cast("long").alias("o")), vectors, cosine)
    ranked = first.join(F.broadcast(_among(scores, first)), "id", "left").orderBy(F.desc_nulls_last("score"), "o")
    seeds = cut(ranked.limit(20).select("id"))
    more = siblings(seeds, claims, in_scope, current, 4, 20, 40).join(F.broadcast(first), "id", "left_anti")
    both = cut(first.select("id", "o").unionByName(more.select("id", (F.lit(1_000_000) + F.row_number().over(Window.orderBy("id"))).cast("long").alias("o"))))  # of 40 rows at most
    kept = _collapsed(both, vectors, cosine)
    stated = _among(claims.select(F.col("claim_id").alias("id"), "text"), kept).select("id", rules.is_limitation(F.col("text")).alias("limit"))
    kept = kept.join(F.broadcast(_among(scores, kept)), "id", "left").join(F.broadcast(stated), "id")
    kept = cut(kept.select("id", "o", F.coalesce("score", F.lit(-1.0)).alias("score"), "limit"))
    limited = kept.filter("limit").orderBy(F.desc("score"), "o").limit(limits)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "o"))
    chosen = retrieval.diverse(kept.filter("not limit").join(F.broadcast(_among(vectors, kept)), "id").select(F.lit(0).cast("long").alias("query_id"), "id", "score", "v"), k, weight)
    return chosen.select("id", "place", F.lit("supported").alias("kind")).unionByName(limited.select("id", place.alias("place"), F.lit("limitation").alias("kind")))


def _collapsed(rows: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """id, o of the rows that are no near duplicate of an earlier one."""
    items = cut(vectors.join(F.broadcast(rows), "id").select(F.lit(0).alias("b"), F.col("o").alias("id"), "v"))
    kept = dedup.collapse_near_duplicates(items, "b", cosine).filter("id = kept").select(F.col("id").alias("o"))
    return cut(rows.join(F.broadcast(kept), "o", "left_semi"))


def grade_items(lines: DataFrame, facts: DataFrame, floor: float, unnamed_floor: float) -> DataFrame:
    """line, grade, reason, missing: how far the facts that an item cites support it.

    lines: line, words (of the item), terms (of the question), markers (facts' ids, in order). facts: id, words (of text
    and titles), limitation, score (null: none). A fact names the item if it has half of its words; confirmed by the
    first cited fact that names it at or above the floor and has all terms; else it needs validation, by the first that
    names it (`missing_terms`) or by any cited fact at or above the lower floor (`unnamed`); else it is dropped.
    """
    # Words of a fact are one string, and what a line looks for in it is made once, before lines meet their facts: each
    # array function over a fact's words would walk through all of them for each of its words.
    asked = lambda c: F.transform(c, lambda w: F.named_struct(F.lit("word"), w, F.lit("needles"), _needles(w)))
    cited = lines.select("line", asked("words").alias("item"), asked("terms").alias("terms"), F.posexplode_outer("markers").alias("pos", "id"))
    cited = cited.join(facts.select("id", _haystack(F.col("words")).alias("words"), "limitation", "score"), "id", "left")
    has = lambda w: F.exists(w["needles"], lambda n: F.contains(F.col("words"), n))
    named = F.size(F.filter("item", has)) * 2 >= F.size("item")
    missing = F.transform(F.filter("terms", lambda w: ~has(w)), lambda w: w["word"])
    scored = F.col("score").isNull() | (F.col("score") >= floor)
    there = F.coalesce(~F.col("limitation"), F.lit(False))
    x = cited.select("line", "pos", there.alias("there"), F.coalesce(there & scored & named, F.lit(False)).alias("named"), missing.alias("missing"), F.coalesce(F.col("score") >= unnamed_floor, F.lit(False)).alias("near"))
    g = x.groupBy("line").agg(
        F.bool_or("there").alias("there"), F.bool_or(F.col("named") & (F.size("missing") == 0)).alias("confirmed"), F.min_by(F.when(F.col("named"), F.col("missing")), F.when(F.col("named"), F.col("pos"))).alias("first"),
        F.bool_or("named").alias("named"), F.bool_or(F.col("there") & F.col("near")).alias("near"),
    )
    grade = F.when(F.col("confirmed"), "confirmed").when(F.col("named") | F.col("near"), "needs_validation").otherwise("dropped")
    reason = F.when(F.col("confirmed"), "named").when(F.col("named"), "missing_terms").when(~F.col("there"), "no_marker").when(F.col("near"), "unnamed").otherwise("below_floor")
    return g.select("line", grade.alias("grade"), reason.alias("reason"), F.when(reason == "missing_terms", F.array_join("first", " ")).otherwise("").alias("missing"))


_END = "\0"  # between words


def _haystack(words: Column) -> Column:
    """Words, none of them empty, each between two ends."""
    return F.concat(F.lit(_END), F.array_join(words, _END), F.lit(_END))


def _needles(term: Column) -> Column:
    """What has one of these strings (of _haystack()) has the term: its stem begins one of the words; of fewer than four
    letters it is one, or its plural."""
    end = F.lit(_END)

    def of(s: Column) -> Column:
        ies = F.concat(end, F.substring(s, F.lit(1), F.length(s) - 1), F.lit("ie"))
        plural = F.concat(end, s, F.lit("s"), end)
        return F.when(s == "", F.array(plural)).when(F.length(s) < 4, F.array(F.concat(end, s, end), plural)).when(s.endswith("y"), F.array(F.concat(end, s), ies)).otherwise(F.array(F.concat(end, s)))

    return rules.let(rules.stem_of(term), of)
