import random

import pytest
import test_decontaminate
import test_jaccard
import test_secrets
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm.language import fit_language_model, identify_language
from quillgraph.llm.queries import held_out

DE = "der hund und die katze laufen schnell im wald weil es heute warm ist".split()
EN = "the dog and a cat run fast in this wood because it was warm today".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(EN) + str(rng.randrange(50)) for _ in range(20))) for i in range(6)]
    rows = []
    for i in range(160):
        lang = rng.choice(["de", "en"])
        text = " ".join(rng.choice(DE if lang == "de" else EN) for _ in range(rng.randint(20, 60)))
        if i % 11 == 0:
            text += " " + rng.choice(items)[1][:90]
        if i % 13 == 0:
            text += " token = \"0123456789abcdef\""
        rows.append((i, text, lang, rng.choice(["big", "big", "big", "small", None]), len(text)))
    for i in range(160, 200):  # near and exact copies, at times of copies
        _, text, lang, source, _ = rng.choice(rows)
        rows.append((i, text if i % 2 else text + " end", lang, source, len(text)))
    rows += [(300, None, "en", "big", 0), (301, "", None, None, 0), (302, "123 456", "en", "small", 7), (5, rows[5][1], "en", "big", 1), (None, "the cat and the dog", "en", "big", 1), (None, "the cat and the dog", "en", "big", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def plain(spark, path, items):
    """The first four stages with the brute-force versions of the operators' tests; what language ID rejects is taken from
    the operator, whose predictions test_language.py holds against centroids."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = fit_language_model(docs, ~held_out(F.col("doc_id")))
    judged = identify_language(docs, model, keep=["text"]).filter("not rejected").collect()
    yield "language_id", sorted([(r.doc_id, r.text) for r in judged], key=str)
    rows = [(r.doc_id, r.text) for r in judged]
    group = dict(zip([(str(i), t) for i, t in rows], _groups(rows), strict=True))
    best: dict = {}
    for i, t in rows:
        g = group[str(i), t]
        if g not in best or (i is None, i or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = (i, t)
    rows = list(best.values())
    yield "near_duplicates", sorted(rows, key=str)
    hit = {(i, t) for (i, t) in rows if test_decontaminate.brute([(i, t)], items)[0][2]}
    rows = [r for r in rows if r not in hit]
    yield "decontamination", sorted(rows, key=str)
    rows = [r for r in rows if not test_secrets.brute(r[1])]
    yield "secrets", sorted(rows, key=str)


def _groups(rows):
    sets = [test_jaccard.shingles(t) for _, t in rows]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return bool(both) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both)

    return test_jaccard.roots(len(rows), linked)


def test_stages_match_plain_python(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    last = docs.count()
    stages = dict(corpus_pipeline.STAGES)
    for name, want in plain(spark, path, items):
        docs = stages[name](spark, docs, path).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert sorted([(r.doc_id, r.text) for r in docs.collect()], key=str) == want
        assert docs.count() < last, name
        last = docs.count()
    mixed = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in docs.collect()}
    assert mixed.filter("epoch > 0").count() > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]
