"""URL filters: longest matching rule, else a verdict by link-graph propagation.

Trust begins at the hosts of pages that a rule allows and follows links; distrust begins at the hosts of pages that a
rule blocks and follows links backwards (who links to bad hosts is suspect). Both are personalised PageRanks over edges
between hosts, computed together: an edge's endpoints carry the kind of rank. A host is blocked if its distrust is
above its share and over `ratio` times its trust.

Cost: links are summed per pair of hosts before they are shuffled. A round joins edges with ranks on (kind, source) and
sums by target with map-side partial sums; a host with very many edges is split by adaptive skew joins. Each round is
written to the checkpoint folder. All native.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

Rule = tuple[str, str]  # action (allow or block), host/path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links that name a host: absolute, or relative to the scheme.
_HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an absolute URL; both empty for null or without `://`."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of rule and action, or null: the longest that fits; of equally long ones the first by text, then allow."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]), reverse=True):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def propagate(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Personalised PageRanks. nodes: kind, host, seed (seeds of a kind sum to 1); edges: kind, src, dst, share (shares of
    a source sum to 1). What hosts without links hold goes back to the seeds. Returns kind, host, rank."""
    ranks = nodes.select("kind", "host", F.col("seed").alias("rank"))
    if edges.isEmpty():  # nothing moves
        return ranks
    for _ in range(rounds):
        moved = edges.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("moved"))
        moved = cut(moved)
        kept = {r.kind: r.kept for r in moved.groupBy("kind").agg(F.sum("moved").alias("kept")).collect()}  # two numbers
        back = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1 - damping * v)) for k, v in kept.items()], F.lit(1.0)) if kept else F.lit(1.0)
        ranks = nodes.join(moved, ["kind", "host"], "left").select("kind", "host", (F.coalesce("moved", F.lit(0.0)) * damping + F.col("seed") * back).alias("rank"))
    return cut(ranks)


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = 10, damping: float = 0.85, ratio: float = 2.0, most_broadcast: int = 20_000
) -> DataFrame:
    """One row per row of pages: id, host, path, rule (null if none fits), verdict (allow or block), trust and distrust
    of the host.

    Null or malformed URLs have empty host and path and are allowed; so is a host that no rank reaches. Null html has no
    links; links from pages without a host, and within a host, are ignored. Repeated rows count each, as pages and as
    links.
    """
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    rows = rows.select("_id", "_html", host.alias("host"), path.alias("path"))
    rows = rows.select("*", matching_rule(F.col("host"), F.col("path"), rules).alias("_rule"))
    action = F.col("_rule.action")
    counts = rows.filter(F.col("host") != "").groupBy("host").agg(F.count(F.when(action == "allow", 1)).alias("trust"), F.count(F.when(action == "block", 1)).alias("distrust"))
    links = rows.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("_html", F.lit(_HREF), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = cut(links)
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    totals = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    edges = cut(edges.join(totals, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")))
    hosts = counts.unionByName(links.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("trust"), F.lit(0).cast("long").alias("distrust")))
    hosts = cut(hosts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    nodes = hosts.select("host", F.stack(F.lit(2), F.lit("trust"), F.col("trust") / (total.trust or 1), F.lit("distrust"), F.col("distrust") / (total.distrust or 1)).alias("kind", "seed"))
    ranks = propagate(nodes, edges, rounds, damping)
    per = ranks.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("trust", "distrust")])
    blocked = (F.col("distrust") * total.hosts > 1) & (F.col("distrust") > ratio * F.col("trust"))
    verdict = F.coalesce(action, F.when(blocked, "block").otherwise("allow"))
    if total.hosts <= most_broadcast:  # else by shuffle; adaptive execution may split a host with very many pages
        per = F.broadcast(per)
    return rows.drop("_html").join(per, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
