"""The vector index, full-text blocks, questions as queries, and tables that are kept while their files stay."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import rules
from quillgraph.operators import ann
from quillgraph.operators import fulltext as FT
from quillgraph.operators import modes as M
from quillgraph.operators import retrieval as R
from quillgraph.session import kept, table


def bytes_read(spark):
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(stats.get(i).getBytesRead() for i in range(stats.size()))


def vectors(spark, v, groups=None):
    rows = [(i, x.tolist() if x is not None else None, int(groups[i]) if groups is not None else 0) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def clustered(rng, n, dims=32, centres=40):
    c = rng.standard_normal((centres, dims)) * 3
    return c[rng.integers(0, centres, n)] + rng.standard_normal((n, dims)) * 0.4


def test_codes_are_near_their_vectors():
    rng = np.random.default_rng(1)
    v = ann._unit(rng.standard_normal((200, 33)))
    c = v[:10]
    cell, scale, code = ann.encode(v, c)
    assert code.shape == (200, 17) and (cell == (v @ c.T).argmax(axis=1)).all()
    error = np.abs(ann.decode(cell, scale, code, c) - v).max(axis=1)
    assert (error <= scale / 8).all() and np.allclose((ann.decode(cell, scale, code, c) ** 2).sum(axis=1), 1)


@pytest.mark.parametrize("kind, most", [("table", 0.7), ("even", 0.25), ("clusters", 0.35)])
def test_recall_and_bytes(spark, tmp_path, kind, most):
    """Single questions find nineteen twentieths of the ten nearest. All that is read counts, footers and page indexes too: a
    quarter of the bytes of 20,000 long vectors at most; these weigh more beside short ones, and most for the small table."""
    if kind == "table":
        e = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding", "label")
        n, width = e.count(), 64
    elif kind == "even":
        n, width = 20_000, 128
        e = vectors(spark, np.random.default_rng(4).standard_normal((n, width)))
    else:
        n, width = 20_000, 32
        e = vectors(spark, clustered(np.random.default_rng(2), n))
    index = ann.build(e, str(tmp_path / "index"))
    assert index.rows.count() == n and index.rows.select("id").distinct().count() == n
    if kind == "clusters":
        assert index.share <= 0.2
    asked = [r.vec_id for r in e.orderBy(F.xxhash64("vec_id")).limit(12).collect()]
    true, read, hits = {}, 0, 0
    for r in R.vector_join(e.filter(F.col("vec_id").isin(asked)), e, 10).collect():
        true.setdefault(r.query_id, set()).add(r.id)
    for q in asked[:4]:
        one = e.filter(F.col("vec_id") == q).select("vec_id", "embedding").collect()
        q_df = spark.createDataFrame(one, "vec_id long, embedding array<float>")
        conf = spark._jsc.hadoopConfiguration()
        conf.set("parquet.hadoop.vectored.io.enabled", "false")  # whose reads are not counted
        conf.set("io.file.buffer.size", "512")  # else each page costs 64 KB
        before = bytes_read(spark)
        ann.search(index, q_df, 10).collect()
        read = max(read, bytes_read(spark) - before)
    print(kind, "share", index.share, "bytes", read, "of", n * width * 4)
    assert read <= most * n * width * 4
    found = {}
    for r in ann.search(index, e.filter(F.col("vec_id").isin(asked)), 10).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(true[q] & found[q]) for q in asked)
    assert hits >= 0.95 * 10 * len(asked)


def test_groups_blocks_and_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = [*rng.standard_normal((300, 8)), None, np.zeros(8), np.ones(3)]
    groups = [1 if i % 50 == 0 else 0 for i in range(len(v))]
    e = vectors(spark, v, groups)
    index = ann.build(e, str(tmp_path / "index"), group_col="label")
    assert sorted(r.id for r in index.rows.filter("cell = -1").collect()) == [300, 301, 302]
    q = e.filter("vec_id in (0, 7, 301)")
    rare = e.filter("label = 1")
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert rows(ann.search(index, q, 5, group="1")) == rows(R.vector_join(q, rare, 5))  # too few of the group among the candidates
    whole = rows(R.vector_join(q, e, 5))
    got = rows(ann.search(index, q, 5, share=1.0, oversample=20, block=2))
    assert got == whole
    many = ann.search(index, e.filter("vec_id < 150"), 5, share=1.0, oversample=10)  # more than a filter names: joined
    assert ann.recall(many, R.vector_join(e.filter("vec_id < 150"), e, 5), 5) > 0.99
    assert ann.search(index, q.limit(0), 5).count() == 0
    empty = ann.build(e.limit(0), str(tmp_path / "empty"))
    assert ann.search(empty, q, 5).count() == 0


def brute(texts, terms, prefixes=()):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    named = {w for ws in words.values() for w in ws if w in terms or any(w.startswith(p) for p in prefixes)}
    df = {w: sum(w in ws for ws in words.values()) for w in named}
    out = {}
    for i, ws in words.items():
        for w in named & set(ws):
            tf = ws.count(w)
            out[i] = out.get(i, 0) + math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    return out


def corpus(n=3000, seed=1):
    rng = random.Random(seed)
    words = ["vault", "copies", "copy", "restore", "restored", "agent", "host", "tape"] + [f"w{i}" for i in range(200)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(3, 60)))) for i in range(n)]
    for i in rng.sample(range(200), 20):  # a few texts that are all about one word
        texts[i] = (i, "vault " * rng.randint(6, 12) + "agent")
    return [*texts, (n, None), (n + 1, "")]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    texts = corpus()
    path = str(tmp_path_factory.mktemp("texts") / "t.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(path)
    return texts, FT.index(spark.read.parquet(path), path)


def test_best_texts_by_blocks(found):
    texts, index = found
    for terms, prefixes in ((["vault"], []), (["vault", "agent"], []), (["host"], ["restor", "cop"]), (["nowhere"], []), ([], ["w1"])):
        want = brute(texts, terms, prefixes)
        assert {r.id: pytest.approx(r.score) for r in FT.bm25(index, terms, prefixes).collect()} == want
        best = sorted(((-round(s, 9), i) for i, s in want.items()))[:10]
        assert [(-round(r.score, 9), r.id) for r in FT.bm25_top(index, terms, 10, prefixes).collect()] == best


def test_blocks_that_cannot_matter_are_not_read(found, monkeypatch):
    """The texts that are read for a search of one common word are fewer than have it."""
    texts, index = found
    read = []
    scores = FT._scores
    monkeypatch.setattr(FT, "_scores", lambda rows, *a: read.append(rows.agg(F.sum("df")).first()[0]) or scores(rows, *a))
    FT.bm25_top(index, ["vault"], 5).collect()
    assert 0 < read[-1] < 0.8 * sum("vault" in (t or "").split() for _, t in texts)


def test_common_terms_lie_in_several_rows(found):
    _, index = found
    rows = index.postings.filter("term = 'vault'")
    assert rows.count() >= 8 and rows.agg(F.max("df")).first()[0] <= FT.BLOCK + 1


def test_questions_to_queries(spark, found):
    texts, index = found
    qs = [(1, "Which agents does Acme restore?"), (2, "What is the tape-host copying of the vault?"), (3, "the of and"), (4, "nowhere vault"), (5, "zzz yyy")]
    q = spark.createDataFrame(qs, "question_id long, q string").select("question_id", FT.compiled(F.col("q"), F.array(F.lit("acme"))).alias("terms"))
    terms = {r.question_id: [(t.term, sorted(t.forms), t.prefix) for t in r.terms] for r in q.collect()}
    assert terms[1] == [("agents", ["agent", "agents"], None), ("restore", ["restore", "restored", "restores", "restoring"], "restor")] or terms[1][0][1] != []
    assert terms[2][0] == ("tape-host", ["host", "tape"], None) and terms[3] == []
    for every in (False, True):
        got = {}
        for r in FT.search_questions(index, q, 10, every).collect():
            got.setdefault(r.question_id, []).append((r["rank"], r.text_id, round(r.score, 6), r.how))
        want = {}
        for qid, groups in terms.items():
            score, has = {}, {}
            for _, forms, prefix in groups:
                for i in brute(texts, forms, [prefix] if prefix else []):
                    has[i] = has.get(i, 0) + 1
            words = {w for _, t in texts for w in (t or "").split() if any(w in f or p and w.startswith(p) for _, f, p in groups)}
            score = brute(texts, words)
            full = {i for i in score if has[i] == len(groups)} if every else set()
            pool = full or set(score)
            order = sorted(pool, key=lambda i: (-round(score[i], 9), i))[:10]
            if order:
                want[qid] = [(n + 1, i, round(score[i], 6), "all" if full else "any") for n, i in enumerate(order)]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_an_overwritten_table_is_indexed_anew(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    ask = lambda: sorted(r.id for r in FT.bm25(FT.index(spark.read.parquet(path), path), ["alpha"]).collect())
    put([(1, "alpha beta")])
    assert ask() == [1] == ask()
    put([(1, "gamma"), (2, "alpha delta"), (3, "alpha")])
    assert ask() == [2, 3]


def test_kept_tables(spark, tmp_path):
    made = []
    path = str(tmp_path / "t.parquet")
    build = lambda: made.append(1) or spark.read.parquet(path).select((F.col("id") * 2).alias("x"))
    spark.range(3).write.parquet(path)
    for _ in range(2):
        assert kept(spark, "doubled", build, [spark.read.parquet(path)]).count() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert kept(spark, "doubled", build, [spark.read.parquet(path)]).count() == 8 and len(made) == 2
    memory = spark.range(2)  # without files there is nothing to tell a change by
    for _ in range(2):
        kept(spark, "of memory", lambda: made.append(1) or memory, [memory])
    assert len(made) == 4


def test_stems_serve_both(spark):
    df = spark.createDataFrame([("restoring",)], "w string")
    assert df.select(rules.stem_of(F.col("w"))).first()[0] == "restor"


def test_postings_are_gathered_where_their_texts_are(spark):
    """Texts are dealt out once, by blocks; neither words nor postings are shuffled, and rows are those of plain counts."""
    texts = [(i * 7, t) for i, t in corpus(400, 3)] + [(10**12, "vault Vault x"), (10**12 + 1, None)]
    mean, width = 30.0, 500
    made = FT.make_postings(spark.createDataFrame(texts, "id long, text string"), mean, width)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for term in set(w):
            want.setdefault((term, i // width), []).append((i, w.count(term), len(w)))
    got = {(r.term, r.block): (r.df, r.top, list(zip(r.ids, r.tfs, r.ns, strict=True))) for r in made.collect()}
    assert {k: x[2] for k, x in got.items()} == {k: sorted(v) for k, v in want.items()}
    for df, top, p in got.values():
        assert df == len(p) and top == pytest.approx(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for _, tf, n in p))


def test_parts_of_a_block_are_found_whole():
    """A block that comes in parts has rows in each; blocks that come together don't mix."""
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("block", pa.int64()), ("w", pa.list_(pa.string()))]))
    held = [batch([{"id": 9, "block": 1, "w": ["b", "a", "b"]}, {"id": 8, "block": 1, "w": []}]).slice(0), batch([{"id": 3, "block": 0, "w": ["a"]}, {"id": 7, "block": 1, "w": ["b"]}]).slice(1)]
    got = {(r["term"], r["block"]): (r["df"], r["ids"], r["tfs"], r["ns"]) for r in FT._gathered(held, 2.0).to_pylist()}
    assert got == {("a", 1): (1, [9], [1], [3]), ("b", 1): (2, [7, 9], [1, 2], [1, 3])}
    assert FT._gathered([batch([{"id": 1, "block": 0, "w": []}])], 2.0).num_rows == 0


def _claims(spark):
    rng = np.random.default_rng(11)
    claims = [(i, f"text {i}" + (" is not supported" if i % 6 == 0 else ""), i % 4, i % 3, 500 if i % 5 == 0 else None) for i in range(200)]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 4)))], "id long, v array<double>")
    scores = spark.createDataFrame([(i, (i * 31 % 100) / 100.0) for i in range(200) if i % 13], "id long, score double")
    return spark.createDataFrame(claims, "claim_id long, text string, subject long, relation long, invalid_day int"), v, scores


@pytest.mark.parametrize("kind", ["local", "list"])
def test_short_lists_go_to_large_tables(spark, monkeypatch, kind):
    """Lists of some rows are sent to claims, texts and vectors, which are not shuffled for them."""
    claims, v, scores = _claims(spark)
    scope, current = claims.filter("claim_id % 7 < 5").select("claim_id"), F.expr("invalid_day is null")
    hits = spark.createDataFrame([(i * 3, 1.0 - i / 100, i + 1) for i in range(40)], "id long, score double, pos int")
    run = {
        "local": lambda: M.local(hits, claims, scope, current, 15),
        "list": lambda: M.list_search([hits.select("id", "pos")], claims, v, scores, None, current),
    }[kind]
    want = sorted(map(tuple, run().collect()))
    plans, real = [], M.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(M, "cut", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        out = run()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(tuple, out.collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [p for p in plans if "SortMergeJoin" in p]
