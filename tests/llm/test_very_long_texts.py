"""One text of some megabytes among short ones, for the operators whose own test files have none."""

import pytest
from pyspark.sql import functions as F

from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.licenses import TEMPLATES, scan_licenses
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.quality import judge_quality
from quillgraph.llm.queries import URL_RULES, contamination_digest, op3_token_counts
from quillgraph.llm.secrets import scan_secrets
from quillgraph.llm.urls import judge_urls

FILLER = "".join(f"walk{i % 977} green{i % 31}\n" if i % 9 == 0 else f"house{i % 1009} " for i in range(300_000))  # 3 MB


@pytest.fixture(scope="module")
def long(documents):
    return lambda text: documents([(1, text, "en", "big"), (2, "short", "en", "small")])


def row(df, i=1):
    (r,) = df.filter(F.col("doc_id") == i).collect()
    return r


def test_secrets(long):
    text = FILLER + 'token="abcdefgh1" ' + FILLER + "AKIA" + "A1" * 10
    parts = [(p.kind, p.start, p.end) for p in row(scan_secrets(long(text))).parts]
    at = len(FILLER)
    assert parts == [("assign", at, at + len('token="abcdefgh1')), ("access", len(text) - 24, len(text))]


def test_quality(long):
    r = row(judge_quality(long(FILLER), {}))
    words = FILLER.split()
    assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), 0)


def test_tokens(long, tmp_path, spark):
    P, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    long(FILLER).drop("_text").write.parquet(str(tmp_path / "documents.parquet"))
    r = row(op3_token_counts(spark, str(tmp_path)))
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert r.n_tokens == len(library.encode(FILLER, add_special_tokens=False).ids) and r.n_bytes == len(FILLER) and r.over_limit


def test_mixing(long):
    uses = mix_sources(long(FILLER)).collect()
    assert {r.n_tokens for r in uses if r.doc_id == 1} == {len(FILLER.split())} and {r.doc_id for r in uses} == {1, 2}


def test_urls(spark):
    html = FILLER + '<a href="https://far.org/x">'
    pages = spark.createDataFrame([(1, "https://example.com/en/7", html), (2, "https://far.org/y", "")], "page_id long, url string, html string")
    found = {r.page_id: (r.verdict, r.trust > 0) for r in judge_urls(pages, URL_RULES).collect()}
    assert found == {1: ("allow", True), 2: ("allow", True)}  # the link at the end of the page carries trust


def test_licenses(long):
    text = FILLER + "\n\n" + TEMPLATES["MIT-notice"] + "\n\n" + FILLER
    assert {m.license for m in row(scan_licenses(long(text))).matches} >= {"MIT-notice"}


def test_benchmark_passages(long, spark):
    passage = "Seldom did the quick brown otter jump over seventeen lazy ponds"
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    r = row(contamination_digest(decontaminate(long(FILLER + passage + " " + FILLER), items)))
    assert (r.n_hit, r.n_items, r.contaminated) == (11, 1, True)
