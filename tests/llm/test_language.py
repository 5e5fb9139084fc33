import pytest
from pyspark.sql import functions as F

from quillgraph.llm.language import fit_language_model, identify_language
from quillgraph.llm.queries import held_out, op7_language_centroids
from quillgraph.session import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    judged = op7_language_centroids(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    hits, n, far = judged.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.count_if("rejected")).first()
    assert n > 150 and hits > 0.98 and far <= 2
    assert judged.filter("score < 0 or score > 1").count() == 0


def test_nearest_centroid_is_the_largest_cosine(documents):
    import numpy as np
    import pyarrow as pa

    from quillgraph.llm import text as T
    from quillgraph.llm.language import features

    rows = [(i, f"der hund und die katze {i}", "de") for i in range(40)] + [(100 + i, f"the dog and the cat {i}", "en") for i in range(40)]
    docs = documents(rows)
    model = fit_language_model(docs, F.lit(True), clusters=2)
    texts = ["der hund", "the dog", "und the katze"]
    (c,) = T.chunks(pa.array(texts))
    v = np.log1p(features(c)) * model.idf
    want = [model.languages[model.owner[max(range(len(model.centroids)), key=lambda k: float(x @ model.centroids[k]))]] for x in v]
    got = {r.doc_id: r.lang_pred for r in identify_language(documents(list(enumerate(texts))), model).collect()}
    assert [got[i] for i in range(3)] == want and want[:2] == ["de", "en"]


def test_features_count_grams():
    import pyarrow as pa

    from quillgraph.llm import text as T
    from quillgraph.llm.language import features

    (c,) = T.chunks(pa.array(["ab c", "", "Ab  12 c"]))
    x = features(c)
    assert x[0].sum() == 3 + 2 + 1 and x[1].sum() == 0
    assert x[2].sum() == 2 + 1 + 1  # ab, b_; ab_; and _c: grams with two separators in a row are left out


def test_odd_rows(documents, odd):
    docs = documents([*[(i + 100, "der hund und die katze laufen im wald", "de") for i in range(60)], *[(*r, None) for r in odd]], extra="_k0")
    model = fit_language_model(docs, ~held_out(F.col("doc_id")))
    out = {(r.doc_id, r.text): r for r in identify_language(docs, model, keep=["text", "_k0"]).select("doc_id", "text", "lang_pred", "score", "rejected").collect()}
    for key in ((1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!"), (8, "😀 😀 😀")):
        assert (out[key].lang_pred, out[key].score, out[key].rejected) == ("und", 0.0, True)
    assert out[(5, "word")].lang_pred == "de" and 0 <= out[(5, "word")].score <= 1


@pytest.mark.parametrize("rows", [[], [(1, "abc", None)], [(1, None, "en")]])
def test_nothing_to_learn_from(documents, rows):
    docs = documents(rows)
    model = fit_language_model(docs, F.lit(True))
    assert model.languages == []
    assert [(r.lang_pred, r.rejected) for r in identify_language(docs, model).collect()] == [("und", True)] * len(rows)


def brute_model(samples, clusters=3, rounds=8, margin=0.6):
    """Fit and rejection bounds in plain loops, on dicts of counts by slot."""
    import math

    texts = {k: sorted(v, key=lambda t: (t[0].tobytes(), t[1].tobytes())) for k, v in samples.items()}
    rows = {k: [dict(zip(s.tolist(), c.tolist(), strict=True)) for s, c in v] for k, v in texts.items()}
    everyone = [t for v in rows.values() for t in v]
    df: dict = {}
    for t in everyone:
        for s in t:
            df[s] = df.get(s, 0) + 1
    idf = lambda s: math.log((1 + len(everyone)) / (1 + df.get(s, 0))) + 1

    def unit(v):
        n = math.sqrt(sum(x * x for x in v.values()))
        return {s: x / n for s, x in v.items()}

    def dot(a, b):
        return sum(x * b.get(s, 0.0) for s, x in a.items())

    def add(vs):
        out: dict = {}
        for v in vs:
            for s, x in v.items():
                out[s] = out.get(s, 0.0) + x
        return out

    vectors = {k: [unit({s: math.log1p(c) * idf(s) for s, c in t.items()}) for t in v] for k, v in rows.items()}
    centroids = []
    for name in sorted(vectors):
        vs = vectors[name]
        mean = {s: x / len(vs) for s, x in add(vs).items()}
        chosen = [max(range(len(vs)), key=lambda i: (dot(vs[i], mean), -i))]
        while len(chosen) < min(clusters, len(vs)):
            chosen.append(min(range(len(vs)), key=lambda i: (max(dot(vs[i], vs[j]) for j in chosen), i)))
        cs = [vs[i] for i in chosen]
        for _ in range(rounds):
            at = [max(range(len(cs)), key=lambda j: (dot(v, cs[j]), -j)) for v in vs]
            cs = [unit(add([v for v, a in zip(vs, at, strict=True) if a == j])) if j in at else cs[j] for j in range(len(cs))]
        centroids += [(name, c) for c in cs]
    top, length = [], []
    for name in sorted(vectors):
        for v, t in zip(vectors[name], rows[name], strict=True):
            top.append(max(dot(v, c) for _, c in centroids))
            length.append(min(int(math.log2(sum(t.values()) + 1)), 19))
    least = []
    for size in range(20):
        near = sorted(x for x, n in zip(top, length, strict=True) if abs(n - size) <= 1)
        if len(near) < 20:
            least.append(0.0)
            continue
        place = 0.02 * (len(near) - 1)
        i = int(place)
        least.append(margin * (near[i] + (place - i) * (near[min(i + 1, len(near) - 1)] - near[i])))
    return centroids, least


def test_fit_and_rejection_are_those_of_plain_loops():
    import random

    import numpy as np
    import pyarrow as pa

    from quillgraph.llm import text as T
    from quillgraph.llm.language import features, fit

    rng = random.Random(3)
    words = {"a": ["hund", "katze", "wald", "und", "der"], "b": ["dog", "cat", "wood", "and", "the"], "c": ["perro", "gato", "bosque", "y", "el"]}
    samples = {}
    for k, w in words.items():
        (c,) = T.chunks(pa.array([" ".join(rng.choice(w) + rng.choice("abcdef") for _ in range(rng.randint(4, 30))) for _ in range(25)]))
        samples[k] = [(np.flatnonzero(r).astype(np.uint16), r[np.flatnonzero(r)].astype(np.uint16)) for r in features(c)]
    centroids, least = brute_model(samples)
    model = fit(samples)
    assert [model.languages[i] for i in model.owner] == [name for name, _ in centroids]
    for got, (_, want) in zip(model.centroids, centroids, strict=True):
        assert abs(float(sum(got[s] * x for s, x in want.items())) - 1) < 1e-4
    assert model.least == pytest.approx(least, abs=1e-4)
    fit_again = fit({k: v[::-1] for k, v in samples.items()})  # in another order
    assert np.array_equal(model.centroids, fit_again.centroids)


def test_every_label_is_learned(documents):
    """Seventy labels, of which each has its own words."""
    rows = [(100 * n + i, f"wa{chr(97 + n % 26)}{chr(97 + n // 26)}o ki{chr(97 + n // 26)}{chr(97 + n % 26)}u " * 5, f"l{n:02d}") for n in range(70) for i in range(3)]
    model = fit_language_model(documents(rows), F.lit(True))
    assert len(model.languages) == 70
    judged = identify_language(documents(rows), model, keep=["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in judged) > 0.95 * len(rows)


def test_very_long_text(documents):
    docs = documents([*[(i, "der hund und die katze laufen im wald", "de") for i in range(30)], *[(50 + i, "the dog and the cat run in the wood", "en") for i in range(30)]])
    model = fit_language_model(docs, F.lit(True))
    (r,) = identify_language(documents([(1, "the dog and the cat run in the wood " * 100_000)]), model).collect()
    assert r.lang_pred == "en"
