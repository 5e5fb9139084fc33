import re

import duckdb
import pytest

from quillgraph.llm.queries import URL_RULES, op5_link_graph_propagation
from quillgraph.llm.sql import ORACLES
from quillgraph.llm.urls import judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(len(r), r, a) for a, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows, rounds=10, damping=0.85, ratio=2.0):
    """Power iteration in plain Python."""
    from collections import Counter, defaultdict

    links, seeds, hosts = Counter(), {"trust": Counter(), "distrust": Counter()}, set()
    for _, url, html in rows:
        host, path = parts(url)
        if not host:
            continue
        hosts.add(host)
        action = rule_of(host, path)[1]
        if action:
            seeds["trust" if action == "allow" else "distrust"][host] += 1
        for to in re.findall(r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)""", html or ""):
            to = to.lower()
            if to != host:
                links[host, to] += 1
                hosts.add(to)
    rank = {}
    for kind in seeds:
        edges = links if kind == "trust" else Counter({(b, a): n for (a, b), n in links.items()})
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        total = sum(seeds[kind].values()) or 1
        s = {h: seeds[kind][h] / total for h in hosts}
        r = dict(s)
        for _ in range(rounds if links else 0):
            moved = defaultdict(float)
            for (a, b), n in edges.items():
                moved[b] += r[a] * n / out[a]
            kept = sum(moved.values())
            r = {h: damping * moved[h] + s[h] * (1 - damping * kept) for h in hosts}
        rank[kind] = r
    out = []
    for i, url, _ in rows:
        host, path = parts(url)
        rule, action = rule_of(host, path)
        t, d = rank["trust"].get(host, 0.0), rank["distrust"].get(host, 0.0)
        out.append((i, host, path, rule, action or ("block" if d * len(hosts) > 1 and d > ratio * t else "allow"), round(t, 9), round(d, 9)))
    return sorted(out, key=str)


ROWS = [
    (1, "https://a.com/en/1", '<a href="http://b.org/x">'), (2, "http://A.com/en/2?q#f", "<a href='//c.net/'> <a href=https://d.io>"), (3, "http://example.com/en/77/", '<a href="http://d.io/"><a href="/local">'),
    (4, "https://sub.example.com/en/7", None), (5, "https://b.org/fr", '<A HREF="HTTP://A.com/"> <a href="http://e.info">'), (6, "http://c.net", '<a href="http://a.com/y">'), (7, "http://c.net?x://y", ""),
    (8, "d.io/none", "<a href='http://z.com'>"), (9, None, None), (10, "http://d.io#x", '<a href="http://example.com/">'), (11, "https://es.org/es/", "<a href='http://a.com'>"), (11, "https://es.org/es/", "<a href='http://a.com'>"),
    (None, "ftp://example.net/de/8", "<a href=//c.net>"), (12, "http://net/de/x", ""), (13, "://", ""), (14, "http:///path", "<a href='http://a.com'>"), (15, "http://e.info/é", ""), (16, "http://xcom/en/", ""),
]


@pytest.mark.parametrize("most", [20_000, 0])
@pytest.mark.parametrize("rows", [ROWS, [(1, "http://a.com/en/", None), (2, "http://a.com/x", None)], []])
def test_verdicts_are_those_of_power_iteration(spark, rows, most):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in judge_urls(pages, URL_RULES, most_broadcast=most).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_distrust_reaches_those_who_link_to_blocked_hosts(spark):
    rows = [(1, "http://bad.com/en/", ""), (2, "http://farm.io/", "<a href='http://bad.com'>"), (3, "http://fine.io/", "<a href='http://good.io'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, URL_RULES).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_query_and_sql_judge_by_the_rules_of_the_contract(spark, tmp_path):
    contract = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = ["http://a.com/en/1", "http://www.example.com/en/77", "http://a.net/de/1", "http://example.net/de/7", "http://x.example.net/de/8/y", "http://b.org/es/"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = [(r.rule, r.verdict) for r in op5_link_graph_propagation(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert rows == [(r, contract[r]) for r in ("com/en/", "example.com/en/7", "net/de/", "net/de/", "example.net/de/8", "org/es/")]
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert c.execute(f"select rule, verdict from ({ORACLES['op5_link_graph_propagation']}) order by page_id").fetchall() == rows
