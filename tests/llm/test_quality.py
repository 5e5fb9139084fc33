import math
import re
from collections import Counter

import pytest

from quillgraph.llm.quality import judge_quality, language_references


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def prose(n, seed=0):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to in is that it for was house river walked green seldom because".split()) for _ in range(n)) + "."


def test_base_counts_match_plain_python(documents, odd):
    rows = [*odd, (20, "a b c d e f a b c d e"), (21, "a b c d e a b c d e"), (22, "x y\nx y\n\n z \nx y\n \n"), (23, "# * $ % & | < >"), (24, prose(300)), (25, "ß\nß"), (26, "\n\na\n")]
    found = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge_quality(documents(rows), {}).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=str) == sorted([(i, *base(t)) for i, t in rows], key=str) and key


def test_divergence_drops_symbols_and_keeps_prose(documents):
    clean = [(i, prose(200, i), "en") for i in range(30)]
    junk = [(100, " ".join(f"{w}$$$%%%" for w in prose(200, 99).split()), "en"), (101, "7 " * 3 + " ".join(str(7**i) for i in range(120)), None)]
    short = [(200, "### *** $$$ a b c d e f g h i j", "en")]
    docs = documents([*clean, *junk, *short])
    kept = {r.doc_id: r for r in judge_quality(docs, language_references(docs)).collect()}
    assert all(kept[i].kept for i, *_ in clean)
    assert not kept[100].kept and not kept[101].kept
    assert kept[200].kept and kept[200].class_distance is None  # too short to judge


def test_js_distance_is_the_formula():
    import numpy as np

    from quillgraph.llm.quality import js_distance

    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a)
    got = js_distance(np.array([[50, 25, 25, 0], [0, 0, 0, 0]]), np.array([10, 0, 40, 50]))
    assert got[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and got[1] == 1


def test_empty(documents):
    docs = documents([])
    assert language_references(docs) == {} and judge_quality(docs, {}).count() == 0


def test_every_label_has_a_reference(documents):
    docs = documents([(i, prose(60 + i, i), f"l{i:03}") for i in range(70)])
    refs = language_references(docs)
    assert sorted(refs) == [f"l{i:03}" for i in range(70)]
    own = documents([(1, " ".join(f"zz{i}$%" for i in range(100)), "rare"), *[(10 + i, prose(200, i), f"l{i:03}") for i in range(70)]])
    (judged,) = judge_quality(own.filter("doc_id = 1"), language_references(own)).collect()
    assert judged.kept and judged.class_distance == 0  # the label with the fewest words has its own reference
