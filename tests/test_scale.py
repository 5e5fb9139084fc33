"""Operators beyond the sizes at which their earlier forms ended, against exact or plain versions."""

import random
import time
import tracemalloc
from fractions import Fraction
from itertools import pairwise
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import chunking as C
from quillgraph.operators import datasets as DS
from quillgraph.operators import evals as E
from quillgraph.operators import fulltext as FT
from quillgraph.operators import graphs as G
from quillgraph.operators import jobs as J
from quillgraph.operators import retrieval as RT
from quillgraph.operators.ordered import fold_groups, running
from quillgraph.plans import registry
from quillgraph.streaming import feeds


def test_sign_test_for_many_pairs(spark):
    cases = [(0, 0), (3, 7), (5, 5), (560, 500), (700, 400), (60_000, 59_000), (50_300, 49_700)]

    def exact(w, n_):
        n, k = w + n_, min(w, n_)
        if not n:
            return 1.0
        term = total = comb(n, k)
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            total += term
        return min(1.0, float(Fraction(2 * total, 1 << n)))

    got = spark.createDataFrame(cases, "w int, l int").select("w", "l", E.sign_test(F.col("w"), F.col("l")).alias("p")).collect()
    assert {(r.w, r.l): r.p for r in got} == {c: pytest.approx(exact(*c), rel=1e-6, abs=1e-300) for c in cases}


def test_matching_of_a_long_chain(spark):
    """Each fresh community is best for the kept one of the pair before: sixty rounds of mutual best."""
    n = 60
    fresh, kept, node = [], [], 0
    for i in range(n):
        for name, size in ((f"k{i:02d}", 200 - 2 * i), (f"k{i + 1:02d}", 199 - 2 * i)):
            for _ in range(size):
                fresh.append((0, f"f{i:02d}", node))
                kept.append((0, name, node))
                node += 1
    one, two = (spark.createDataFrame(x, "level int, community string, node long") for x in (fresh, kept))
    got = {(r.fresh, r.kept) for r in G.match_communities(one, two, 0.1).collect()}
    sets = lambda rows: {c: {m for _, d, m in rows if d == c} for c in {r[1] for r in rows}}
    a, b = sets(fresh), sets(kept)
    pairs = sorted((-(len(x & y) / len(x | y)), f, k) for f, x in a.items() for k, y in b.items() if x & y and len(x & y) / len(x | y) >= 0.1)
    want, used = set(), set()
    for _, f, k in pairs:
        if f not in used and k not in used:
            used |= {f, k}
            want.add((f, k))
    assert got == want and len(got) == n


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(9)])) for i in range(500)] + [("hot", 1000 + i, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o long, v int").repartition(7)
    got = {r.o: (r.place, r.before, r.n, r.total) for r in running(df, ["g"], [F.col("o")], F.col("v")).collect()}
    want, state = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        n, s = state.get(g, (0, 0))
        want[o] = (n + 1, s)
        state[g] = (n + 1, s + (v or 0))
    assert got == {o: (*want[o], *state[g]) for g, o, _ in rows}
    whole = running(df, [], [F.col("o")]).select("o", "place").collect()
    assert [r.o for r in sorted(whole, key=lambda r: r.place)] == sorted(o for _, o, _ in rows)
    assert running(df.limit(0), ["g"], [F.col("o")]).count() == 0


def test_folds_stream_over_batches(spark):
    rows = spark.range(25_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))

    def gaps(key, own):
        for a, b in pairwise(r["o"] for r in own):
            if b - a != 2:
                yield (*key, a)
        yield (*key, -1)

    assert sorted(map(tuple, fold_groups(rows, ["k"], ["o"], gaps, "k long, x long").collect())) == [(0, -1), (1, -1)]


def test_full_text_over_postings(spark):
    docs = spark.createDataFrame([(1, "Red fox red"), (2, "a reddish fox"), (3, None), (4, "blue"), (5, "redo it")], "doc_id long, text string")
    found = FT.index(docs, f"small {time.time()}")
    assert (found.docs, found.mean) == (5, pytest.approx(9 / 5))
    n, mean = 5, 9 / 5
    score = lambda tf, df, size: np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    got = {r.id: r.score for r in FT.bm25(found, ["red", "fox", "fox"]).collect()}
    assert got == {1: pytest.approx(score(2, 1, 3) + score(1, 2, 3)), 2: pytest.approx(score(1, 2, 3))}
    assert {r.id for r in FT.bm25(found, [], ["red"]).collect()} == {1, 2, 5}
    assert FT.bm25(found, []).count() == 0
    plan = FT.bm25(found, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,red)" in plan and "regexp" not in plan
    assert {r.id for r in FT.bm25(found, [], ["re"]).collect()} == {1, 2, 5}  # prefixes of any length


def test_nearest_with_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (1200, 4)).astype(float)  # many equal and some zero vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [0, 7, 1199, 5000]
    want = {}
    unit = lambda x: x / max(np.linalg.norm(x), 1e-300)
    for i in q:
        a = unit(np.array(rows[i][1])) if i < 1200 else np.zeros(4)
        order = sorted((-round(float(a @ unit(np.array(x))) if x is not None and len(x) == 4 else 0.0, 9), j) for j, x in rows if j != i)
        want[i] = [-s for s, _ in order[:15]]
    for kw in ({}, {"block": 2}):
        got: dict = {}
        for r in sorted(RT.vector_join(table.filter(F.col("vec_id").isin(q)), table, 15, **kw).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((round(r.score, 9), r.id))
        assert {i: [s for s, _ in x] for i, x in got.items()} == {i: pytest.approx(s) for i, s in want.items()}
        assert all(x == sorted(x, key=lambda t: (-t[0], t[1])) for x in got.values())
    assert RT.vector_join(table.limit(0), table, 3).count() == 0


def test_nearest_within_groups(spark):
    """Of a query's own group alone, by the matrices of the exact search; no pair of rows is a row of a join."""
    rng = np.random.default_rng(4)
    v, g = rng.normal(size=(600, 5)), [None if i % 50 == 3 else i % 7 for i in range(600)]
    table = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(v, g, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in RT.vector_join(table.filter("vec_id % 20 = 3 or vec_id < 2"), table, 4, group_col="label").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    asked = [i for i in range(600) if (i % 20 == 3 or i < 2) and g[i] is not None]
    assert got == {i: sorted((j for j in range(600) if j != i and g[j] == g[i]), key=lambda j: -unit[i] @ unit[j])[:4] for i in asked}


def test_recall_joins_no_pairs(spark, sf):
    plan = registry.queries()["agg_32_recall_at_10"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and plan.count("MapInArrow") == 2


def test_scores_of_many_queries_are_held_in_steps():
    """What a task holds beside its batch doesn't grow with queries times rows."""
    rng = np.random.default_rng(5)
    asked, v = rng.normal(size=(5000, 4)), rng.normal(size=(2000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    out = next(iter(RT._nearest(np.arange(5000), asked, 10)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 50_000 and peak < 80e6


def test_reached_in_one_edge_or_two(spark, monkeypatch):
    """Over ranges, a node with very many ends, ends that several nodes share, loops, doubles and nodes without a way on."""
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(30, 130)) for _ in range(900)] + [(7, i) for i in range(40, 400)] + [(50, 50), (10**12, 7), (10**12, 7)]
    to: dict = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    want = {a: len(x | {c for b in x for c in to.get(b, ())}) for a, x in to.items()}
    df = spark.createDataFrame(edges, "src long, dst long")
    out = G.reached_in_two(df, block=200)
    assert {r.src: r.reached for r in out.collect()} == want
    assert {r.src: r.reached for r in G.reached_in_two(df).collect()} == want
    monkeypatch.setattr(G, "_PAIRS", 50)  # in this process
    pairs = sorted(set(edges))
    edges_, beyond = pa.table({"src": [a for a, _ in pairs], "dst": [b for _, b in pairs]}), pa.table({"mid": [a for a, _ in pairs], "end": [b for _, b in pairs]})
    got = G._count_reached(edges_, beyond)
    assert dict(zip(got["src"].to_pylist(), got["reached"].to_pylist(), strict=True)) == want
    none = G._count_reached(edges_, pa.table({"mid": pa.array([], pa.int64()), "end": pa.array([], pa.int64())}))
    assert none["reached"].to_pylist() == [len(to[a]) for a in sorted(to)]


def test_worst_cosine_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[int(rng.integers(2))], i, rng.standard_normal(3).tolist()) for i in range(90)] + [("one", 900, [1.0, 0.0, 0.0])]
    got = {r.g: r.worst for r in RT.worst_cosine(spark.createDataFrame(rows, "g string, id long, v array<double>"), "g", block=20).collect()}
    for g in "ab":
        u = np.array([np.array(v) / np.linalg.norm(v) for h, _, v in rows if h == g])
        assert got[g] == pytest.approx((u @ u.T)[np.triu_indices(len(u), 1)].min())
    assert set(got) == {"a", "b"}


@pytest.mark.parametrize("seed", range(4))
def test_balanced_pairs(spark, seed):
    import hashlib

    rng = random.Random(seed)
    rows = [(i, rng.choice("ABC"), rng.choice([[-3, -1], [1, 2], [0, 1, 4]][seed % 3])) for i in range(60)]
    got = DS.balance(spark.createDataFrame(rows, "id long, kind string, delta int"), "s").collect()
    order = lambda kind: sorted((r for r in rows if r[1] == kind), key=lambda r: (hashlib.sha256(f"{kind}:s:{r[0]}".encode()).hexdigest()))
    mean = lambda p: sum(x[2] for x in p) / len(p) if p else 0.0
    pairs, c, b = [r for r in rows if r[1] in "AC"], order("C"), order("B")
    while pairs and mean(pairs) > 0.25 and c:
        pairs.remove(c.pop())
    while mean(pairs) < 0 and b:
        pairs.append(b.pop())
    assert {r.id for r in got} == {p[0] for p in pairs} and {r.ok for r in got} == {abs(mean(pairs)) <= 0.25}


def test_lexical_overlap_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([4, 26])]) for _ in range(n))
    items, docs = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(99, None)], [(i, text(rng.randint(0, 12))) for i in range(60)]
    got = {(r.item_id, r.doc_id): r.overlap for r in DS.lexical_overlap(spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(docs, "doc_id int, text string"), 0.5).collect()}
    want = {}
    for i, t in items:
        for d, u in docs:
            a, b = set((t or "").split()), set(u.split())
            if a and len(a & b) / len(a) >= 0.5:
                want[i, d] = pytest.approx(len(a & b) / len(a))
    assert got == want


def test_queue_transitions(spark):
    rows = [(1, 10, "in_progress", 2, "2024-01-01", "2024-01-01"), (2, 20, "in_progress", 0, "2024-01-01", "2024-01-01"), (3, 20, "pending", 0, None, "2024-01-01"), (4, 30, "done", 1, "2024-01-01", "2024-01-01")]
    jobs = spark.createDataFrame(rows, "job_id long, article_id long, status string, attempts long, claimed_at string, next_at string").select("job_id", "article_id", "status", "attempts", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("claimed_at", "next_at")])
    claim = lambda *ids: spark.createDataFrame([(i, at) for i, at in ids], "job_id long, at string").select("job_id", F.col("at").cast("timestamp_ntz").alias("claimed_at"))
    done = {r.job_id: r.status for r in J.complete(jobs, claim((1, "2024-01-01"), (2, "2024-01-02"), (4, "2024-01-01"))).collect()}
    assert done == {1: "done", 2: "in_progress", 3: "pending", 4: "done"}
    later = {r.job_id: (r.status, r.attempts, r.claimed_at is None, str(r.next_at)) for r in J.defer(jobs, claim((1, "2024-01-01"), (2, "2024-01-01")), F.expr("timestamp_ntz'2024-03-01 00:00:00'"), 60).collect()}
    assert later[1] == ("pending", 2, True, "2024-03-01 00:01:00") and 2 not in later and later[4][0] == "done"


def test_contents_of_any_depth(spark):
    tree = '{"id":"r","title":"R","children":[{"id":"a","title":"A","children":[{"id":"b","title":"B"}]},{"id":"c","title":"C","children":null}]}'
    got = {tuple(r) for r in C.flatten_toc(spark.createDataFrame([(tree,), ("{bad",), (None,)], "j string"), "j").collect()}
    assert got == {("r", "R", None, 0, 0), ("a", "A", "r", 1, 0), ("b", "B", "a", 2, 0), ("c", "C", "r", 1, 1)}


def _stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k long, s string").select("k", F.col("s").cast("timestamp").alias("ts")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))


EVENTS = [(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50"), (1, "2024-01-01 00:03:00"), (2, "2024-01-01 00:01:30")]


def _drained(spark, tmp_path, stream, mode):
    feeds.run_once(stream, str(tmp_path / f"state-{mode}"), feeds.to_files(str(tmp_path / f"out-{mode}"), mode), mode)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / f"out-{mode}"))


def test_windows_and_sessions_of_a_stream(spark, tmp_path):
    stream = _stream(spark, tmp_path, EVENTS)
    w = _drained(spark, tmp_path, feeds.windowed(stream, "ts", "1 minute", "1 minute", None, ["k"], {"n": F.count("*")}), "complete")
    assert sorted((r.k, r.start.minute, r.n) for r in w.collect()) == [(1, 0, 2), (1, 3, 1), (2, 1, 1)]
    s = _drained(spark, tmp_path / "s", feeds.sessions(_stream(spark, tmp_path / "s", EVENTS), "ts", "1 minute", "1 minute", ["k"]), "complete")
    assert sorted((r.k, r.start.minute, r.events) for r in s.collect()) == [(1, 0, 2), (1, 3, 1), (2, 1, 1)]


def test_debounced_stream(spark, tmp_path):
    out = _drained(spark, tmp_path, feeds.debounced(_stream(spark, tmp_path, EVENTS), "k", "ts", 60), "append")
    assert sorted((r.k, r.at % 3600) for r in out.collect()) == [(1, 10), (1, 180), (2, 90)]


def test_poll_loop_picks_up_what_comes(spark, tmp_path):
    """A periodic trigger: files that come while it runs are taken, each once."""
    stream, seen = _stream(spark, tmp_path, EVENTS[:2]), []

    def each(batch, _):
        seen.extend(r.k for r in batch.collect())
        if len(seen) == 2:
            spark.createDataFrame(EVENTS[2:], "k long, s string").select("k", F.col("s").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    feeds.run_once(stream, str(tmp_path / "state"), each, every="200 milliseconds", until=lambda: len(seen) >= 4)
    assert sorted(seen) == [1, 1, 1, 2]
