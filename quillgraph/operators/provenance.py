"""The structural chain and the provenance of facts over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut


def alive(link_superseded: Column, article_removed: Column, episode_removed: Column) -> Column:
    """A missing flag is false."""
    off = F.lit(False)
    return ~F.coalesce(link_superseded, off) & ~F.coalesce(article_removed, off) & ~F.coalesce(episode_removed, off)


def chain(article: DataFrame, source: DataFrame, product: DataFrame, vendor: DataFrame, how: str = "inner") -> DataFrame:
    """Articles with their source, product and vendor. Catalog tables are small or not: the optimiser decides by size."""
    return (
        article.join(source.select("source_id", "source", "product_id"), "source_id", how)
        .join(product.select("product_id", "product", "vendor_id"), "product_id", how)
        .join(vendor.select("vendor_id", "vendor"), "vendor_id", how)
    )


def fact_sources(fact_episode: DataFrame, episode: DataFrame, chained: DataFrame) -> DataFrame:
    """Distinct (fact, article, source, product, vendor) of facts with resolvable provenance."""
    links = fact_episode.join(episode.select("episode_id", "article_id"), "episode_id")
    return links.select("fact_id", "article_id").distinct().join(chained.select("article_id", "source_id", "source", "product", "vendor"), "article_id")


def scope_condition(vendors: list[str] = (), products: list[str] = (), sources: list[str] = ()) -> Column:
    """Dimensions are alternatives; names compare in lower case; no name at all admits everything."""
    out = None
    for column, names in (("vendor", vendors), ("product", products), ("source", sources)):
        if names:
            one = F.lower(F.col(column)).isin([n.lower() for n in names])
            out = one if out is None else out | one
    return F.lit(True) if out is None else out


def support(fact: DataFrame, fact_episode: DataFrame, episode: DataFrame, article: DataFrame) -> DataFrame:
    """For each fact with episodes: how many, how many alive, and when the last of them died.

    Links and deaths are summed per episode before they meet facts, so that neither multiplies the other.
    """
    state = episode.join(article.select("article_id", "removed"), "article_id", "left").select(
        "episode_id", alive(F.col("superseded"), F.col("removed"), F.lit(None).cast("boolean")).alias("alive"), "died_at"
    )
    return (
        fact.select("fact_id").join(fact_episode, "fact_id").join(state, "episode_id", "left").groupBy("fact_id")
        .agg(F.count("*").alias("episodes"), F.count_if(F.coalesce("alive", F.lit(False))).alias("alive"), F.max("died_at").alias("died_at"))
    )


def staleness_sweep(fact: DataFrame, fact_episode: DataFrame, episode: DataFrame, article: DataFrame, now: Column) -> DataFrame:
    """Facts that are current but have lost every episode, with the date on which they end; of facts that share an id the
    current ones count, in one row."""
    gone = support(fact.filter(F.col("invalid_at").isNull()), fact_episode, episode, article).filter("alive = 0")
    return gone.select("fact_id", "episodes", F.coalesce("died_at", now).alias("invalid_at"))


_SENT = 200_000  # claims that are sent to every task, rather than joined by a shuffle
_ANSWERS = 25_000  # answers of a task, about


def cited(answers: DataFrame, claims: DataFrame, known: int) -> DataFrame:
    """answer_id, marker, place, and the claim that it cites: markers from 1 to `known`, in order of appearance, each once.

    answers: answer_id, size, numbers (its markers); marker m cites the claim of number size + m. claims: claim_id and more.
    Claims that many answers cite would gather all of these in one task of a join by claim: as long as they are few, the
    claims that are cited at all are sent to the answers, which are shuffled once, before their markers are rows.
    """
    named = lambda n: (n >= 1) & (n <= known)
    some = answers.select("answer_id", "size", "numbers", F.array_distinct(F.filter("numbers", named)).alias("markers")).filter(F.size("markers") > 0)
    wanted = cut(some.select(F.explode("markers").alias("m"), "size").select((F.col("size") + F.col("m")).alias("claim_id")).distinct())
    if wanted.count() <= _SENT:
        claims = cut(claims.join(F.broadcast(wanted), "claim_id", "left_semi"))
        claims = F.broadcast(claims) if claims.count() <= _SENT else claims
    parts = max(1, -(-answers.count() // _ANSWERS))
    each = some.repartition(parts, "answer_id").select("answer_id", "size", "numbers", F.explode("markers").alias("marker"))
    first = each.select("answer_id", "size", "marker", F.array_position("numbers", F.col("marker")).alias("pos"))
    first = first.groupBy("answer_id", "size", "marker").agg(F.min("pos").alias("pos"))  # of answers that share an id
    found = first.withColumn("_claim", F.col("size") + F.col("marker")).join(claims, F.col("_claim") == F.col("claim_id"))
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))  # of one answer
    return found.select(*[c for c in first.columns if c != "pos"], place.alias("place"), *claims.columns)
