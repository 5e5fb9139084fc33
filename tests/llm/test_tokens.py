import random

import pytest

from quillgraph.llm.tokens import Counter, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_match_the_library(library):
    rng = random.Random(1)
    alphabet = "aabc '\n\t  stredlm09é<|>endoftxÿ漢☃ \x85\x1c😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 1000, "<|endoftext|>" * 3 + " x<|endoftext|>", "", "aaaaaaa " * 50, " " * 777 + "x", "\n\n  \n x", "don't we'll I'd", "Hello world! " * 100]
    assert Counter(PATH)(texts) == library(texts)


def test_every_character(library):
    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    texts = ["a" + x + " b" + x + x + "1" for x in chars]
    assert Counter(PATH)(texts) == library(texts)


def test_odd_rows(documents, odd, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(documents(odd, extra="n_tokens"), PATH).collect())
    assert got == sorted((str(i), len((t or "").encode()), n) for (i, t), n in zip(odd, library([t or "" for _, t in odd]), strict=True))
    assert token_counts(documents([]), PATH).count() == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"id": 1, "content": "x", "special": False}]}])
def test_files_that_ask_for_more_are_refused(tmp_path, change):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    for k, v in change.items():
        spec[k] = spec[k] | v if k == "model" else v
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="not supported"):
        Counter(str(tmp_path / "v.json"))
