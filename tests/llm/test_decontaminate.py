import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.queries import contamination_digest


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for at in range(len(w) - m + 1):
                if (g := tuple(w[at : at + m])) in windows:
                    hit.update(range(at, at + m))
                    found |= windows[g]
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=str)


def data(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice(["", "", "1"])
    items = [(i, rng.choice([" ", ", ", "-"]).join(word() for _ in range(rng.choice([1, 2, 4, 9, 10, 11, 15, 30])))) for i in range(25)]
    items += [(100, items[-1][1]), (100, None), (101, ""), (None, "zeta1 zeta1 zeta1 zeta1 zeta1 zeta1 zeta1 zeta1 zeta1 zeta1")]
    rows = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 1))
            parts += w[a : a + rng.choice([9, 10, 12, 40])]
        rows.append((i, " ".join(parts + [word() for _ in range(5)]).upper()))
    return [*rows, (1000, "zeta1 " * 25)], items


@pytest.mark.parametrize("block_words", [2_000_000, 60])
def test_hits_are_those_of_all_windows(spark, documents, odd, block_words):
    rows, items = data()
    rows += odd
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(documents(rows, extra="spans"), bench, block_words=block_words)
    got = sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in found.collect()], key=str)
    assert got == brute(rows, items)
    for r in found.collect():
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_empty_tables_and_kept_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c d e f g h i j k"), (2, None)])
    assert contamination_digest(decontaminate(docs, none)).filter("contaminated").count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    kept = decontaminate(docs.withColumn("n_words", F.lit("mine")), some, keep=["n_words", "text"])
    assert kept.columns == ["doc_id", "n_words", "text", "n_words", "spans", "items"] and kept.count() == 2
    assert decontaminate(documents([]), some).count() == 0


def test_long_items_are_cut_without_loss(spark, documents):
    from quillgraph.llm import decontaminate as module

    long = " ".join(f"w{i}" for i in range(500))
    (batch,) = spark.createDataFrame([("1", long)], "item string, text string").coalesce(1).toArrow().to_batches()
    (pieces,) = module._pieces(10, 64)([batch])
    assert pieces.num_rows == 8
    index = module.Index([(r["item"], module.np.frombuffer(r["hashes"], module.np.uint64), r["short"]) for r in pieces.to_pylist()], 10, 5)
    assert len(index.by_length[10].hashes) == 491
