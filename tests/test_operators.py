"""Operators whose rules SQL can't state, against plain Python on small tables."""

import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import strings as S
from quillgraph.functions import vectors as V
from quillgraph.operators import chunking as C
from quillgraph.operators import datasets as DS
from quillgraph.operators import dedup as D
from quillgraph.operators import evals as E
from quillgraph.operators import graphs as G
from quillgraph.operators import jobs as J
from quillgraph.operators import provenance as P
from quillgraph.operators import retrieval as R
from quillgraph.plans import registry
from quillgraph.sources import feed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vectors(spark):
    a, b, zero = F.array(*map(F.lit, [1.0, 2.0, 2.0])), F.array(*map(F.lit, [2.0, 0.0, 1.0])), F.array(*map(F.lit, [0.0, 0.0, 0.0]))
    assert one(spark, V.cosine(a, b)) == pytest.approx(4 / (3 * math.sqrt(5)))
    assert one(spark, V.cosine(a, zero)) is None and one(spark, V.cosine_or_zero(a, zero)) == 0.0
    assert one(spark, V.cosine(a, F.array(F.lit(1.0)))) is None
    assert one(spark, V.quantise(a)) == [64, 127, 127] and one(spark, V.quantise(zero)) == [0, 0, 0]


def test_strings(spark):
    assert one(spark, S.expand_marker_lists(F.lit("a [1, 2,3] b [4] [x, 5]"))) == "a [1] [2] [3] b [4] [x, 5]"
    assert one(spark, S.markers(F.lit("x [1] [22] [a] [3"))) == [1, 22]
    assert one(spark, S.token_key(F.lit("R&D  Team"))) == one(spark, S.token_key(F.lit("r and d team"))) == "r and d team"
    assert one(spark, S.stem(F.lit("walking"))) == "walk" and one(spark, S.stem(F.lit("sing"))) == "sing"
    assert one(spark, S.backoff(F.lit(3))) == 120.0 and one(spark, S.backoff(F.lit(30))) == 3600.0


def test_feed_records(spark, tmp_path):
    lines = ['{"change_type":"added","id":"a","content_hash":"h","extra":1}', "", '{"change_type":"removed","id":"b","removed_at":"2024-01-01"}', '{"control":"cursor","next_since":"x","count":2}', "{broken", "  "]
    (tmp_path / "feed.ndjson").write_text("\n".join(lines))
    got = feed.read_records(spark, str(tmp_path / "feed.ndjson")).select("kind", "id").collect()
    assert sorted((r.kind, r.id) for r in got if r.kind != "malformed") == [("content", "a"), ("control", None), ("tombstone", "b")]
    assert sum(r.kind == "malformed" for r in got) == 1


def test_feed_actions(spark):
    rows = spark.createDataFrame([(None, "a", False, False), ("a", "a", True, False), ("a", "a", False, True), ("a", "a", False, False), ("a", "b", True, True)], "o string, n string, j boolean, e boolean")
    assert [r[0] for r in rows.select(feed.action(F.col("o"), F.col("n"), F.col("j"), F.col("e"))).collect()] == ["enqueue", "skip", "skip", "requeue", "enqueue"]


def test_near_duplicate_collapse(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        v = rng.standard_normal(3)
        rows.append((i % 2, i, v.tolist()))
    got = {r.id: r.kept for r in D.collapse_near_duplicates(spark.createDataFrame(rows, "b int, id long, v array<double>"), "b", 0.8).collect()}
    for block in (0, 1):
        kept = []
        for _, i, v in (r for r in rows if r[0] == block):
            cos = [float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)) for _, w in kept]
            first = next((k for (k, _), c in zip(kept, cos, strict=True) if c >= 0.8), None)
            if first is None:
                kept.append((i, v))
            assert got[i] == (i if first is None else first)


def test_equal_texts_collapse(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i, rng.standard_normal(3).tolist(), rng.choice(["One, two.", "one two", "Three", "four!", f"own {i}"])) for i in range(120)]
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v, _ in rows}
    key = {i: "".join(c if c.isalnum() else " " for c in t.lower()).split() for _, i, _, t in rows}
    kept: list[int] = []
    want = {}
    for _, i, _, _ in rows:
        want[i] = next((k for k in kept if unit[i] @ unit[k] >= 0.95 or key[i] == key[k]), i)
        if want[i] == i:
            kept.append(i)
    items = spark.createDataFrame(rows, "b int, id long, v array<double>, t string")
    for most in (20_000, 30):
        got = {r.id: r.kept for r in D.collapse_near_duplicates(items, "b", 0.95, text_col="t", most=most).collect()}
        assert got == want


def test_near_duplicate_collapse_of_large_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)) if i % 3 else 0, i, rng.standard_normal(3).tolist()) for i in range(300)]
    rows += [(7, 1000 + i, [1.0, 0.5, 0.0]) for i in range(5)]
    rows += [(10 + i % 9, 2000 + i, rng.standard_normal(3).tolist()) for i in range(9 * 45)]
    items = spark.createDataFrame(rows, "b int, id long, v array<double>")
    whole = sorted(map(tuple, D.collapse_near_duplicates(items, "b", 0.9).collect()))
    assert len({k for _, _, k in whole}) > 60
    assert sorted(map(tuple, D.collapse_near_duplicates(items, "b", 0.9, most=40).collect())) == whole


def test_diverse_selection(spark):
    rng = np.random.default_rng(1)
    v, score = rng.standard_normal((12, 4)), rng.random(12)
    rows = [(0, i, float(score[i]), v[i].tolist()) for i in range(12)]
    got = [r.id for r in R.diverse(spark.createDataFrame(rows, "query_id long, id long, score double, v array<double>"), 6).orderBy("place").collect()]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want: list[int] = []
    while len(want) < 6:
        want.append(max((i for i in range(12) if i not in want), key=lambda i: score[i] - 0.5 * max((unit[i] @ unit[j] for j in want), default=0)))
    assert got == want


def test_matching_is_greedy(spark):
    rng = random.Random(4)
    fresh = [(0, f"f{rng.randrange(6)}", n) for n in range(80)]
    kept = [(0, f"k{(int(c[1:]) + (rng.random() < 0.3)) % 6}", n) for _, c, n in fresh if rng.random() < 0.9]
    one_, two = (spark.createDataFrame(x, "level int, community string, node long") for x in (fresh, kept))
    sets = lambda rows: {c: {n for _, d, n in rows if d == c} for c in {r[1] for r in rows}}
    a, b = sets(fresh), sets(kept)
    pairs = sorted((-(len(x & y) / len(x | y)), f, k) for f, x in a.items() for k, y in b.items() if len(x & y) / len(x | y) >= 0.2)
    want, used = [], set()
    for j, f, k in pairs:
        if f not in used and k not in used:
            used |= {f, k}
            want.append((f, k, round(-j, 9)))
    got = [(r.fresh, r.kept, round(r.jaccard, 9)) for r in G.match_communities(one_, two, 0.2).collect()]
    assert sorted(got) == sorted(want)


def test_packing_starts_anew(spark):
    sizes = [3, 4, 4, 9, 1, 1, 12, 2]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "g long, o long, n int")
    got = [r.pack for r in DS.pack_consecutive(rows, "g", "o", F.col("n"), 10).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 2, 3, 4, 5]


def test_fair_share(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(20)]
    given = {r.id: r.given for r in DS.fair_share(spark.createDataFrame([("a", i, n) for i, n in enumerate(sizes)], "g string, id long, size long"), "g", 500).collect()}
    left, level, todo = 500.0, 0.0, sorted(sizes)
    while todo and todo[0] * len(todo) <= left:
        left -= todo.pop(0)
    level = left / len(todo)
    assert all(given[i] == pytest.approx(min(n, level)) for i, n in enumerate(sizes)) and sum(given.values()) == pytest.approx(500)


def test_debounce(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(1000) for _ in range(60))
    rows = spark.createDataFrame([(1, t) for t in times], "k long, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    last, n = None, 0
    for t in times:
        if last is None or t - last > 50:
            last, n = t, n + 1
    assert J.debounce(rows, "k", "ts", 50).first().passed == n


def test_statistics(spark):
    assert one(spark, E.sign_test(F.lit(28).cast("long"), F.lit(0).cast("long"))) == pytest.approx(2 / 2**28)
    assert one(spark, E.sign_test(F.lit(0).cast("long"), F.lit(0).cast("long"))) == 1.0
    assert one(spark, E.sign_test(F.lit(5).cast("long"), F.lit(5).cast("long"))) == 1.0
    low, high = E.wilson(F.lit(8), F.lit(10))
    assert (one(spark, low), one(spark, high)) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    assert [one(spark, E.majority(F.lit(y), F.lit(n))) for y, n in ((1, 1), (1, 2), (2, 3))] == [None, None, True]
    values = spark.range(400).select("id", (F.col("id") % 2).alias("v"))
    r = E.bootstrap_mean(values, "v", "id").first()
    assert 0.43 < r.low < 0.5 < r.high < 0.57 and abs(r.mean - 0.5) < 0.02


def test_vector_join_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((40, 5))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(0, 40, 4) for j in [j for j in np.argsort(-(unit @ unit[i])) if j != i][:3]}
    for block in (100, 3):
        assert {(r.query_id, r.id) for r in R.vector_join(t.filter("vec_id % 4 = 0"), t, 3, block=block).collect()} == want


def test_ndjson_stream_gate(spark, tmp_path):
    """A feed as a stream: each batch against the state so far, malformed lines aside."""
    from quillgraph.streaming import feeds

    (tmp_path / "in").mkdir()
    state: dict[str, str] = {}
    acted: list[tuple[str, str]] = []

    def each(batch, _):
        records = feed.parse_records(batch.withColumnRenamed("value", "line")).filter("kind = 'content'")
        old = spark.createDataFrame(list(state.items()) or [("", "")], "id string, old string")
        for r in records.join(old, "id", "left").select("id", "content_hash", feed.action(F.col("old"), F.col("content_hash"), F.lit(True), F.lit(True)).alias("a")).collect():
            acted.append((r.id, r.a))
            state[r.id] = r.content_hash

    for n, lines in enumerate((['{"change_type":"added","id":"a","content_hash":"1"}', "{bad"], ['{"change_type":"updated","id":"a","content_hash":"1"}', '{"change_type":"added","id":"b","content_hash":"2"}'])):
        (tmp_path / "in" / f"{n}.ndjson").write_text("\n".join(lines))
        feeds.run_once(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "checkpoint"), each)
    assert sorted(acted) == [("a", "enqueue"), ("a", "skip"), ("b", "enqueue")]


def test_seats_within_floors_and_caps(spark):
    """Against a rate that is bisected; floors and caps that can't be met are told by what is given."""
    rng = random.Random(8)
    for case in range(6):
        groups = [(f"g{i}", rng.randint(0, 50) if rng.random() < 0.9 else 0, rng.randint(0, 6), rng.choice([None, rng.randint(6, 20)])) for i in range(rng.randint(1, 9))]
        seats = rng.randint(5, 60)
        df = spark.createDataFrame(groups, "g string, n long, lo int, hi int")
        got = {r.g: r.seats for r in DS.clamped_seats(df, "g", "n", seats, "lo", "hi").collect()}
        share = lambda rate: {g: min(hi if hi is not None else 1e9, max(lo, rate * n)) for g, n, lo, hi in groups}  # noqa: E731, B023
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(share(mid).values()) < seats else (low, mid)
        want = share(high if sum(share(0.0).values()) < seats else 0.0)
        assert all(abs(got[g] - want[g]) < 1 and got[g] >= lo and (hi is None or got[g] <= max(lo, hi)) for g, _, lo, hi in groups), (case, groups, seats, got, want)
        reachable = sum(share(1e6).values())
        assert sum(got.values()) == (sum(lo for _, _, lo, _ in groups) if sum(share(0.0).values()) >= seats else min(seats, round(reachable)))


def test_answers_are_not_gathered_by_what_they_cite(spark, monkeypatch):
    """Few claims that all answers cite: no task has the answers of one of them; with many claims the rows are the same."""
    answers = [(i, i % 3, [[], [2, 9, 2, 1], [0, 8, 1, 8, 3], [5]][i % 4]) for i in range(80)] + [(7, 2, [1, 4])]
    claims = [(i, f"v{i}") for i in range(9)] + [(4, "again")]
    want = []
    for a in {a for a, *_ in answers}:
        firsts = {}
        for _, size, numbers in [x for x in answers if x[0] == a]:
            for m in {n for n in numbers if 1 <= n <= 8}:
                firsts[size, m] = min(firsts.get((size, m), 99), numbers.index(m))
        want += [(a, m, size + m, v) for size, m in firsts for c, v in claims if c == size + m]
    one, two = spark.createDataFrame(answers, "answer_id long, size int, numbers array<int>"), spark.createDataFrame(claims, "claim_id long, vendor string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.cited(one, two, 8)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
        monkeypatch.setattr(P, "_SENT", 0)
        many = P.cited(one, two, 8).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning") == 1
    for got in (rows, many):
        assert sorted((r.answer_id, r.marker, r.claim_id, r.vendor) for r in got) == sorted(want)
    of = sorted((r.place, r.marker) for r in rows if r.answer_id == 5 and r.vendor != "again")
    assert [m for _, m in of] == [2, 1]


@pytest.mark.parametrize("name", ["gr_1_degrees", "gr_1_projection"])
def test_ends_of_facts_are_not_made_with_whole_facts(spark, sf, tmp_path, name):
    """In a session that has kept no facts, a graph's query shuffles their ends alone, and writes nothing."""
    folder = shutil.copytree(sf, tmp_path / "tables")
    df = registry.queries()[name](spark, str(folder))
    assert {f.split("/")[-1] for f in df.inputFiles()} == {"lineitem.parquet", "orders.parquet"}
    scans = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert scans and not any("l_extendedprice" in x for x in scans)


def test_provenance_makes_no_whole_facts(spark, sf, tmp_path):
    df = registry.queries()["join_1_provenance"](spark, str(shutil.copytree(sf, tmp_path / "tables")))
    assert not [f for f in df.inputFiles() if "/kept/" in f] and not [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "l_extendedprice" in x]
