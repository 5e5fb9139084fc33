"""Full-text search over a table of postings, and questions made into queries for it.

The index of a corpus has a row for each term and block of texts, a block being a range of ids: the ids, counts and
lengths of the texts with the term, and the largest weight that any of them gives it. Rows are sorted by term and block in
ranges over the whole table, so that a common term lies in many files and is written and read by many tasks, and a reader
skips pages of other terms. A search for the best k reads the blocks' heads first; texts of the most promising blocks give
a score that the k-th best surely has, and blocks that can't reach it are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import rules
from quillgraph.functions.strings import tokens
from quillgraph.session import cut, kept

K1, B = 1.2, 0.75
BLOCK = 256  # texts of a block, about
_WORDS = 1_000_000  # words that a task gathers at a time, about
_POSTINGS = "term string, block long, df int, top double, ids array<long>, tfs array<int>, ns array<int>"
_NAMED = 500  # blocks that are named in a filter, rather than joined


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, block, df, top, ids, tfs, ns
    docs: int
    mean: float


def weight(tf: Column, n: Column, mean: float, k1: float = K1, b: float = B) -> Column:
    """What a term gives to the score of a text of n words that has it tf times, but for its rarity."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / F.greatest(F.lit(mean), F.lit(1e-9))))


def _weight(tf: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / max(mean, 1e-9)))


def make_postings(texts: DataFrame, mean: float, width: int) -> DataFrame:
    """texts: id, text. They are dealt out by blocks of ids, and a task counts and gathers the words of its blocks by
    itself, so that neither words nor single postings are shuffled. A block of very many words comes in parts, each with
    rows of its own."""
    block = F.floor(F.col("id") / width)
    dealt = texts.filter("id is not null").select("id", block.alias("block"), "text").repartition("block").sortWithinPartitions("block")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            at = np.asarray(b.column(1))
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]  # blocks follow each other
            for lo, hi in pairwise(cuts):
                n = sum(len(x.column(2).flatten()) for x in held)
                if n >= _WORDS and (held[-1].column(1)[-1].as_py() != at[lo] or n >= 2 * _WORDS):
                    yield _gathered(held, mean)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield _gathered(held, mean)

    return dealt.select("id", "block", tokens(F.coalesce("text", F.lit(""))).alias("w")).mapInArrow(gather, _POSTINGS)


def _gathered(held: list[pa.RecordBatch], mean: float) -> pa.RecordBatch:
    """Texts (id, block, w) as rows of postings: one for each block and term, with its texts by id."""
    all_ = pa.Table.from_batches(held).combine_chunks()
    ids, blocks = all_["id"].to_numpy(), all_["block"].to_numpy()
    sizes, words = pc.list_value_length(all_["w"]).to_numpy(), pc.list_flatten(all_["w"]).combine_chunks()
    order = np.lexsort((ids, blocks))
    ids, blocks, ns = ids[order], blocks[order], sizes[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    coded = words.dictionary_encode()
    kinds, text = max(1, len(coded.dictionary)), np.repeat(place, sizes)
    _, number = np.unique(blocks, return_inverse=True)
    # Words by block, term and text; equal ones are counted.
    key, tfs = np.unique((number[text] * kinds + np.asarray(coded.indices, np.int64)) * len(order) + text, return_counts=True)
    row, text = key // max(1, len(order)), key % max(1, len(order))
    first = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(first[1:], len(row)) if len(row) else first
    tops = np.maximum.reduceat(_weight(tfs, ns[text], mean), first) if len(row) else np.zeros(0)
    lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(v, kind))
    columns = [coded.dictionary.take(pa.array(row[first] % kinds)), blocks[text[first]], pa.array(ends - first, pa.int32()), tops, lists(ids[text], pa.int64()), lists(tfs, pa.int32()), lists(ns[text], pa.int32())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["term", "block", "df", "top", "ids", "tfs", "ns"])


def _write(df: DataFrame, path: str) -> None:
    sorted_ = df.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    sorted_.write.mode("overwrite").option("parquet.page.row.count.limit", 512).parquet(path)


def index(docs: DataFrame, name: str = "", id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of a corpus with distinct whole numbers as ids: written at the first call of a session, read at later
    ones, and written anew when the files of the corpus have changed. Null texts have no terms."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = texts.select("id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    sums = [F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean"), F.min("id").alias("low"), F.max("id").alias("high")]
    s = kept(spark, f"lengths {name} {id_col} {text_col}", lambda: words.agg(*sums), [docs]).first()
    width = max(1, ((s.high or 0) - (s.low or 0) + 1) * BLOCK // max(1, s.docs))
    postings = kept(spark, f"postings {name} {id_col} {text_col}", lambda: make_postings(texts, s["mean"] or 0.0, width), [docs], _write)
    return Index(postings, s.docs, s["mean"] or 0.0)


def _matching(term: Column, terms: list[str], prefixes: list[str]) -> Column:
    hit = term.isin(terms) if terms else F.lit(False)
    for p in prefixes:
        hit = hit | term.startswith(p)
    return hit


def idf(df: Column, docs: int) -> Column:
    return F.log(1 + (F.lit(docs) - df + 0.5) / (df + 0.5))


def _scores(rows: DataFrame, rarity: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    each = rows.join(rarity, "term").select("idf", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p"))
    return each.groupBy(F.col("p.ids").alias("id")).agg(F.sum(F.col("idf") * weight(F.col("p.tfs"), F.col("p.ns"), mean, k1, b)).alias("score"))


def bm25(found: Index, terms: list[str], prefixes: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of the texts with any of the terms, or any term that begins with one of the prefixes, each of which
    counts by itself. Repeated terms count once."""
    rows = found.postings.filter(_matching(F.col("term"), sorted(set(terms)), sorted(set(prefixes or []))))
    return _scores(rows, rows.groupBy("term").agg(idf(F.sum("df"), found.docs).alias("idf")), found.mean, k1, b)


def bm25_top(found: Index, terms: list[str], k: int, prefixes: list[str] | None = None) -> DataFrame:
    """id, score of the k best by bm25(), ties by id; blocks of texts that can't be among them are not read."""
    rows = found.postings.filter(_matching(F.col("term"), sorted(set(terms)), sorted(set(prefixes or []))))
    heads = cut(rows.select("term", "block", "df", "top"))
    rarity = cut(heads.groupBy("term").agg(idf(F.sum("df"), found.docs).alias("idf")))
    bounds = cut(heads.join(rarity, "term").groupBy("block").agg(F.sum(F.col("top") * F.col("idf")).alias("bound"), F.max("df").alias("texts")))
    best = bounds.orderBy(F.desc("bound"), "block").limit(_NAMED).collect()
    first, n = [], 0
    for r in best:  # blocks that hold k texts for sure
        first.append(r.block)
        n += r.texts
        if n >= k:
            break
    if n < k:  # too few in them: all there is
        return _scores(rows, rarity, found.mean, K1, B).orderBy(F.desc("score"), "id").limit(k)
    sure = _scores(rows.filter(F.col("block").isin(first)), rarity, found.mean, K1, B).orderBy(F.desc("score"), "id").limit(k)
    least = min(r.score for r in sure.select("score").collect())
    left = [r.block for r in best if r.bound >= least - 1e-9]
    if len(left) < len(best) or len(best) < _NAMED:
        rows = rows.filter(F.col("block").isin(left))
    else:  # more blocks than a filter names may have some
        rows = rows.join(bounds.filter(F.col("bound") >= least - 1e-9).select("block"), "block", "left_semi")
    return _scores(rows, rarity, found.mean, K1, B).orderBy(F.desc("score"), "id").limit(k)


# Questions -----------------------------------------------------------------------------------------------------------


def compiled(q: Column, drop: Column, prefix_from: int = 6) -> Column:
    """A question as an array of (term, forms, prefix): its distinctive words without those in `drop` (names of the scope),
    each with the forms that count for it, and a prefix (its stem, if that is long enough) or null."""
    stem = lambda w: rules.let(rules.stem_of(w), lambda s: F.when((F.length(s) >= prefix_from) & ~s.contains("-") & ~s.contains("_"), s))
    plain = lambda w: F.filter(rules.word_forms(w), lambda x: x.rlike("^[a-z0-9]+$"))
    parts = lambda w: F.when(w.rlike("[_-]"), F.filter(F.split(w, "[_-]+"), lambda x: x != "")).otherwise(plain(w))
    return F.transform(rules.question_terms(q, drop), lambda w: F.struct(w.alias("term"), parts(w).alias("forms"), stem(w).alias("prefix")))


def search_questions(found: Index, questions: DataFrame, k: int, every: bool = False, id_col: str = "question_id") -> DataFrame:
    """id, text_id, score, rank, how: the k best texts of each question (id, terms as compiled() gives them).

    A term is found by any of its forms, or by what begins with its prefix; each such word counts by itself. With `every`,
    texts must have all of a question's terms; questions for which no text does take those with any (`how`: all, any).
    Questions are joined with the index's terms, so that any number of them is one pass over the postings that they name.
    """
    asked = questions.select(F.col(id_col).alias("_q"), F.size("terms").alias("_terms"), F.posexplode("terms").alias("_g", "t"))
    words = found.postings.groupBy("term").agg(F.sum("df").alias("n"))
    exact = asked.select("_q", "_g", "_terms", F.explode("t.forms").alias("term"))
    begun = asked.filter(F.col("t.prefix").isNotNull()).select("_q", "_g", "_terms", F.col("t.prefix").alias("prefix"))
    sizes = [r[0] for r in begun.select(F.length("prefix")).distinct().collect()]  # lengths of words
    heads = words.select("term", F.explode(F.array(*[F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in sizes])).alias("prefix")) if sizes else words.limit(0).select("term", F.col("term").alias("prefix"))
    named = exact.unionByName(begun.join(heads.filter("prefix is not null"), "prefix").select("_q", "_g", "_terms", "term"))
    named = cut(named.distinct().join(words, "term").select("_q", "_g", "_terms", "term", idf(F.col("n"), found.docs).alias("idf")))
    each = found.postings.join(named, "term").select("_q", "_g", "_terms", "idf", "term", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("p"))
    # A word that stands for two terms of a question counts once, and fulfils both.
    each = each.groupBy("_q", "_terms", F.col("p.ids").alias("text_id"), "term").agg(F.first(F.col("idf") * weight(F.col("p.tfs"), F.col("p.ns"), found.mean)).alias("w"), F.collect_set("_g").alias("g"))
    scored = each.groupBy("_q", "_terms", "text_id").agg(F.sum("w").alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("g")))).alias("_has"))
    scored = scored.withColumn("_all", F.col("_has") == F.col("_terms")) if every else scored.withColumn("_all", F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_all"), F.desc(F.round("score", 9)), "text_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    how = F.when(F.max("_all").over(Window.partitionBy("_q")), "all").otherwise("any")  # of k rows
    top = top.withColumn("how", how).filter(F.col("_all") | (F.col("how") == "any"))
    return top.select(F.col("_q").alias(id_col), "text_id", "score", "rank", "how")
