import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import components, jaccard
from quillgraph.llm.components import components_of_members, connected_components
from quillgraph.llm.jaccard import near_duplicates
from quillgraph.llm.signature_tree import SignatureTree


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(both) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)

    group = roots(len(rows), linked)
    ids: dict = {}
    for (i, _), g in zip(rows, group, strict=True):
        ids.setdefault(g, []).append(i)
    low = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return sorted([(i, len(s), low[g]) for (i, _), s, g in zip(rows, sets, group, strict=True)], key=str)


def corpus(seed, groups=12, most=14):
    """Groups of near copies around the threshold, some sharing passages, some chained."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 8, 20, 60, 120]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: max(1, int(len(t) * rng.choice([0.76, 0.8, 0.9])))]
            texts.append(rng.choice([" ", "  ", "\n"]).join(t))
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("kw", [{}, {"block_sets": 4, "block_tokens": 400}])
def test_components_are_those_of_all_pairs(documents, kw):
    rows = corpus(7)
    found = near_duplicates(documents(rows), **kw).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_common_tokens_change_nothing(documents, monkeypatch):
    """With every class looked at, and tokens of two classes common, none meet in buckets."""
    monkeypatch.setattr(jaccard, "_SAMPLED", 1)
    monkeypatch.setattr(jaccard, "_MANY", 2)
    monkeypatch.setattr(jaccard, "_BUCKET_BYTES", 1000)
    rows = corpus(11)
    found = near_duplicates(documents(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_most_sets_of_a_group_ask(documents):
    """A passage ties many small groups of near copies into one large candidate group of many blocks: nearly all sets lie
    outside of its largest component, and pairs lie in different blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(40):
        base = passage + [word() for _ in range(25)]
        for _ in range(3):
            t = list(base)
            t[rng.randrange(len(passage), len(t))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    found = near_duplicates(documents(rows), block_sets=12, block_tokens=100_000).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert len({r.component_id for r in found}) >= 40


def test_very_long_texts(documents):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**9)}" for _ in range(250_000)]
    near = list(base)
    for i in range(0, len(near), 5000):
        near[i] = "changed"
    rows = [(2, " ".join(base)), (1, " ".join(near)), (3, " ".join(base[:100_000])), (4, "short text of six words here")]
    found = {r.doc_id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert found == {2: 1, 1: 1, 3: 3, 4: 4}


def test_odd_rows(documents, odd):
    rows = [*odd, (30, "WORD"), (31, "a B c D e f"), (32, "A b C d E F")]
    out = near_duplicates(documents(rows, extra="key"))
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=str) == brute(rows)
    # Of "word" the row with the smallest id comes first, twice as it is there twice; texts without words are all first.
    assert out.filter("first and n_shingles = 1 and component_id = 5").count() == 2
    assert out.filter("n_shingles = 0 and not first").count() == 0
    assert near_duplicates(documents([])).count() == 0


def test_tree_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(25):
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
            for _ in range(rng.integers(1, 30)):
                kept = base[rng.random(len(base)) < rng.choice([1, 0.95, 0.87, 0.8, 0.6])]
                s = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, max(1, len(base) // 4)), dtype=np.uint64)]))
                if len(s):
                    sets.append(s)
        if len(sets) < 2:
            continue

        def linked(i, j, sets=sets):
            both = len(np.intersect1d(sets[i], sets[j]))
            return 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)

        assert SignatureTree(sets).components().tolist() == roots(len(sets), linked)
        # Sets of one label are connected; of the other pairs only those count of which one asks.
        label, asks = rng.integers(0, 5, len(sets)), rng.random(len(sets)) < 0.4
        want = roots(len(sets), lambda i, j: label[i] == label[j] or ((asks[i] or asks[j]) and linked(i, j)))
        assert SignatureTree(sets).components(labels=label, asking=asks).tolist() == want


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    linked = {(at[a], at[b]) for a, b in edges} | {(at[b], at[a]) for a, b in edges}
    want = {n: nodes[r] for n, r in zip(nodes, roots(len(nodes), lambda i, j: (i, j) in linked), strict=True)}
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [7, 2_000_000])
def test_components_of_members(spark, monkeypatch, block):
    monkeypatch.setattr(components, "_BLOCK", block)
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(300)) for _ in range(450)] + [(1000 + i, 1) for i in range(300)] + [(2000, 7), (2000, 7)]
    hubs = sorted({h for _, h in pairs})
    of: dict = {}
    for m, h in pairs:
        of.setdefault(m, []).append(hubs.index(h))
    together = {(a, b) for v in of.values() for a in v for b in v}
    root = roots(len(hubs), lambda i, j: (i, j) in together)
    want = {m: hubs[root[v[0]]] for m, v in of.items()}
    got = components_of_members(spark.createDataFrame(pairs, "member long, hub long")).collect()
    assert {r.member: r.label for r in got} == want and len(got) == len(want)
    assert components_of_members(spark.createDataFrame([], "member long, hub long")).count() == 0


def test_hot_group_of_near_copies(documents):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        rows.append((i + 10, " ".join(t)))
    out = near_duplicates(documents(rows), block_sets=50)
    assert out.agg(F.count_distinct("component_id"), F.min("component_id")).first() == (1, 10)


def test_sets_tied_by_chance_do_not_meet_all_blocks(documents, monkeypatch):
    """Each text shares short passages with six others that it doesn't link with, and has a near copy: one candidate
    group of all texts at first. Compared by blocks, each set would go to each block."""
    across = []
    monkeypatch.setattr(jaccard, "_across_blocks", lambda docs, k, large, labels, *rest: across.append(large.count()) or labels)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    bases = 40
    passages = [[word() for _ in range(13)] for _ in range(bases)]
    rows = []
    for g in range(bases):
        parts = [passages[p % bases] for p in (g, g + 1, g + 7)]
        base = [w for p in parts for w in [*p, *[word() for _ in range(27)]]]
        for _ in range(2):
            t = list(base)
            t[rng.randrange(len(t))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    found = near_duplicates(documents(rows), block_sets=12, block_tokens=100_000).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert not across


def test_no_task_has_two_python_workers(documents, monkeypatch):
    """Each operator in Python takes a worker of its own in every task, and these keep their memory."""
    plans, cut = [], components.cut
    for module in (jaccard, components):
        monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = corpus(7, groups=5)
    found = near_duplicates(documents(rows), block_sets=4, block_tokens=400).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert sum("MapInArrow" in p for p in plans) >= 4
    assert not [p for p in plans if re.search(r"MapInArrow[^\n]*\n(?:[ :|+-]*(?:Project|Filter)[^\n]*\n)*[ :|+-]*MapInArrow", p)]
