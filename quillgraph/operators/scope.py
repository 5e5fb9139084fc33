"""Scopes of questions: which vendors, products and document sets a question names.

Names, and aliases of them, are a table of terms. A mention is a run of whole words of the question that equals a term:
questions are cut into all runs of up to as many words as the longest term has, and joined with the terms. Where mentions
overlap, the one that begins first stands, the longest of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import rules

# Words that make a document set's name generic beside its vendor's.
GENERIC = "platform docs documentation doc cloud console portal help center centre guide guides user admin administrator manual reference kb knowledge base support release notes the and".split()


class UnknownName(ValueError):
    """Names that were given for a scope and are none of its kind."""


def distinctive(name: Column, vendor: Column) -> Column:
    """The name holds the vendor's and a word beyond it that isn't generic."""
    rest = F.regexp_extract_all(F.replace(F.lower(name), F.lower(vendor), F.lit(" ")), F.lit(r"[\w&+.-]+"), F.lit(0))
    return F.contains(F.lower(name), F.lower(vendor)) & F.exists(rest, lambda w: ~w.isin(GENERIC))


def names(vendor: DataFrame, product: DataFrame, docset: DataFrame) -> DataFrame:
    """key, kind, name: what a name stands for by itself. vendor: vendor; product: product; docset: name, vendor. Sets count
    if their name is the only one of its kind. distinct: whether the name is looked for in questions."""
    once = docset.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.min("vendor").alias("vendor"), F.count("*").alias("n")).filter("n = 1")
    out = vendor.select(F.lower("vendor").alias("key"), F.lit(1).alias("rank"), F.lit("vendor").alias("kind"), F.col("vendor").alias("name"), F.lit(True).alias("distinct"))
    out = out.unionByName(product.select(F.lower("product").alias("key"), F.lit(2).alias("rank"), F.lit("product").alias("kind"), F.col("product").alias("name"), F.lit(True).alias("distinct")))
    return out.unionByName(once.select("key", F.lit(3).alias("rank"), F.lit("source").alias("kind"), "name", distinctive(F.col("name"), F.col("vendor")).alias("distinct")))


def alias_targets(known: DataFrame, alias: DataFrame) -> DataFrame:
    """key, kind, name of each target of an alias that is known; of equal names the vendor's, then the product's."""
    best = known.groupBy(F.col("key").alias("target_key")).agg(F.min(F.struct("rank", "kind", "name")).alias("t"))
    asked = alias.select(F.lower("alias").alias("key"), F.lower(F.trim("target")).alias("target_key")).distinct()
    return asked.join(best, "target_key").select("key", "t.kind", "t.name").distinct()


def terms(known: DataFrame, alias: DataFrame) -> DataFrame:
    """key, targets (kind, name, sorted): aliases replace names of the same spelling."""
    targets = alias_targets(known, alias).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("kind", "name"))).alias("targets"))
    plain = known.filter("distinct").groupBy("key").agg(F.min(F.struct("rank", "kind", "name")).alias("t")).select("key", F.array(F.struct("t.kind", "t.name")).alias("targets"))
    return targets.unionByName(plain.join(targets.select("key"), "key", "left_anti"))


def _words_at(q: Column) -> Column:
    """Start (from 1) and end of each run of letters, digits and underscores."""
    words, gaps = F.regexp_extract_all(q, F.lit(r"\w+"), F.lit(0)), F.split(q, r"\w+", -1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(s: Column, z: Column) -> Column:
        a = s["at"] + F.length(z["gap"])
        b = a + F.length(z["word"])
        return F.struct(b.alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("a"), (b - 1).alias("b")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def mentions(questions: DataFrame, found: DataFrame, id_col: str = "question_id", q_col: str = "q") -> DataFrame:
    """id, start (from 0), end, targets: the terms that a question names. A mention doesn't follow a hyphen."""
    longest = found.agg(F.max(F.size(F.regexp_extract_all("key", F.lit(r"\w+"), F.lit(0))))).first()[0] or 1
    at = questions.select(F.col(id_col).alias("id"), F.col(q_col).alias("q"), _words_at(F.col(q_col)).alias("w"))
    first = at.select("id", "q", "w", F.posexplode("w").alias("i", "first"))
    runs = first.select("id", "q", "first.a", F.explode(F.slice("w", F.col("i") + 1, F.lit(longest))).alias("last")).select("id", "a", F.col("last.b").alias("b"), F.expr("lower(substring(q, a, last.b - a + 1))").alias("key"), F.expr("substring(q, a - 1, 1) = '-' and a > 1").alias("hyphen"))
    hits = runs.filter(~F.col("hyphen")).join(found, "key").select("id", "a", "b", "targets")
    per = hits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", (-F.col("b")).alias("b"), "targets"))).alias("m"))  # of one question

    def step(s: Column, m: Column) -> Column:
        return F.when(m["a"] > s["end"], F.struct((-m["b"]).alias("end"), F.concat(s["out"], F.array(m)).alias("out"))).otherwise(s)

    start = F.struct(F.lit(0).alias("end"), F.slice("m", 1, F.lit(0)).alias("out"))
    kept = per.select("id", F.explode(F.aggregate("m", start, step, lambda s: s["out"])).alias("m"))
    return kept.select(F.col("id").alias(id_col), (F.col("m.a") - 1).alias("start"), (-F.col("m.b")).alias("end"), "m.targets")


def detected(questions: DataFrame, found: DataFrame, id_col: str = "question_id", q_col: str = "q") -> DataFrame:
    """id, kind, name of what a question is restricted to: its mentions, unless it is worded across vendors."""
    m = mentions(questions.filter(~rules.is_cross_vendor(F.col(q_col))), found, id_col, q_col)
    return m.select(id_col, F.explode("targets").alias("t")).select(id_col, "t.kind", "t.name").distinct()


def explicit(known: DataFrame, alias: DataFrame, given: list[tuple[str, str]]) -> DataFrame:
    """kind, name of the names that were given with their kinds; each must be one of that kind, or an alias of such."""
    spark = known.sparkSession
    asked = spark.createDataFrame([(i, k, n.strip().lower(), n) for i, (k, n) in enumerate(given)], "pos int, kind string, key string, given string")
    own = known.select("key", "kind", "name").join(F.broadcast(asked), ["key", "kind"])  # a short list
    by_alias = alias_targets(known, alias).join(F.broadcast(asked), ["key", "kind"]).join(own.select("key", "kind"), ["key", "kind"], "left_anti")
    hits = own.unionByName(by_alias).select("pos", "kind", "name").distinct().collect()
    missing = [n for i, (_, n) in enumerate(given) if i not in {h.pos for h in hits}]
    if missing:
        raise UnknownName(f"unknown vendor/product/source: {', '.join(missing)}")
    return spark.createDataFrame(sorted({(h.kind, h.name) for h in hits}), "kind string, name string")


def shape(questions: DataFrame, found: DataFrame, vendor_of: DataFrame, id_col: str = "question_id", q_col: str = "q") -> DataFrame:
    """id, shape, sides: enumeration (worded across vendors), comparison (two sides or more), single. A question across
    vendors whose subject is a named one ("Which vendors does X ...", but not "X and Y") is single.

    vendor_of: kind, name, vendor. A vendor that is named beside one of its products or sets is no side of its own."""
    m = mentions(questions, found, id_col, q_col)
    sides = m.groupBy(id_col).agg(F.collect_set("targets").alias("sides"), F.collect_list(F.struct("start", "end")).alias("spans"))
    flat = m.select(id_col, F.explode(F.array_distinct("targets")).alias("t")).join(vendor_of, (F.col("t.kind") == vendor_of["kind"]) & (F.col("t.name") == vendor_of["name"]) & (F.col("t.kind") != "vendor"))
    covered = flat.groupBy(id_col).agg(F.collect_set("vendor").alias("covered"))
    q = questions.select(id_col, q_col).join(sides, id_col, "left").join(covered, id_col, "left")
    none = F.array().cast("array<array<struct<kind:string,name:string>>>")
    vendors_only = lambda s: F.forall(s, lambda t: t["kind"] == "vendor")
    under = lambda s: F.forall(s, lambda t: F.array_contains(F.coalesce("covered", F.array().cast("array<string>")), t["name"]))
    kept = F.filter(F.coalesce("sides", none), lambda s: ~(vendors_only(s) & under(s)))
    # The subject stands behind the opening, and no second mention follows it after "and" or "or".
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    between = lambda s, o: F.trim(F.lower(F.substring(F.col(q_col), s["end"] + 1, o["start"] - s["end"])), F.lit(" ,"))
    paired = lambda s: F.exists(spans, lambda o: (o["start"] > s["end"]) & between(s, o).isin("and", "or"))
    subject = F.exists(spans, lambda s: rules.opens_subject(F.substring(F.col(q_col), F.lit(1), s["start"])) & ~paired(s))
    cross = rules.is_cross_vendor(F.col(q_col))
    kind = F.when(cross & F.coalesce(subject, F.lit(False)), "single").when(cross, "enumeration").when(F.size(kept) >= 2, "comparison").otherwise("single")
    return q.select(id_col, kind.alias("shape"), F.size(kept).alias("sides"))
