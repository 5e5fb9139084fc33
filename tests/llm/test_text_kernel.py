import random
import re

import pyarrow as pa

from quillgraph.llm import text as T


def words_by_regex(text, pattern, lower):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(pattern, text)


def test_words_are_those_of_the_patterns():
    rng = random.Random(3)
    alphabet = "aAbZ z09\t\n\x0b\x0c\r\x1c\x85\xa0é漢😀.-_|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, ""]
    for table, pattern, fold in ((T.SPACED_WORDS, r"[^\x20\x09-\x0D]+", T.AS_IS), (T.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", T.ASCII_LOWER)):
        seen, at = {}, 0
        for c in T.chunks(pa.array(texts), limit=300):
            w = T.words(c, table, fold)
            for r in range(c.rows):
                want = words_by_regex(texts[at + r] or "", pattern, fold is T.ASCII_LOWER)
                got = range(w.bounds[r], w.bounds[r + 1])
                assert len(got) == len(want)
                for i, word in zip(got, want, strict=True):
                    assert seen.setdefault(word, w.hash[i]) == w.hash[i]
            at += c.rows
        assert at == len(texts)
        assert len(set(seen.values())) == len(seen)


def test_grams_stay_within_rows_and_match_runs():
    (c,) = T.chunks(pa.array(["a b c", "b c", "a b c d"]))
    w = T.words(c, T.SPACED_WORDS)
    at, h = T.grams(w, 3)
    assert at.tolist() == [0, 5, 6] and h[0] == h[1] != h[2]
    assert T.run_hash(w.hash[0:3]) == int(h[0])


def test_long_text_comes_alone():
    sizes = [(c.first, c.rows) for c in T.chunks(pa.array(["a" * 5000, "b", "c"]), limit=100)]
    assert sizes == [(0, 1), (1, 2)]
