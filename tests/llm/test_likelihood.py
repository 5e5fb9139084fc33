import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import likelihood as L
from quillgraph.llm import text as T
from quillgraph.llm.likelihood import Network, Vocabulary, build_vocabulary, contexts, encode, score_encoded, score_pseudo_likelihood, targets, train
from quillgraph.session import cut, table


def log_p(net, near, token):
    """Plain: embeddings, hidden layer, group, token within its group."""
    x = np.concatenate([net.embed[t] for t in near]).astype(np.float64)
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    k = net.word.shape[2]
    out = 0.0
    for z, own in ((h @ net.group + net.group_bias, (token - 1) // k), (h @ net.word[(token - 1) // k] + net.word_bias[(token - 1) // k], (token - 1) % k)):
        out += z[own] - math.log(np.exp(z - z.max()).sum()) - z.max()
    return out


def as_double(net):
    return net.like(net.flat().astype(np.float64))


def differences(net, pairs):
    """Gradients of the mean of -log p over (context, token) pairs by central differences."""
    out = []
    for a in net.arrays():
        g = np.zeros_like(a)
        for i in np.ndindex(a.shape):
            was = a[i]
            ends = []
            for d in (1e-5, -1e-5):
                a[i] = was + d
                ends.append(-np.mean([log_p(net, near, t) for near, t in pairs]))
            a[i] = was
            g[i] = (ends[0] - ends[1]) / 2e-5
        out.append(g)
    return out


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = as_double(Network.start(8, 2, 3, 4))
    near, token = rng.integers(0, 8, (6, 4)), rng.integers(1, 8, 6)
    want = differences(net, list(zip(near, token, strict=True)))
    for got, g in zip(net.gradients(near, token).arrays(), want, strict=True):
        assert np.allclose(got, g, atol=1e-6)
    assert np.allclose(net.log_probabilities(near, token), [log_p(net, c, t) for c, t in zip(near, token, strict=True)])


@pytest.mark.parametrize("tokens", [2, 3, 8, 17, 200])
def test_probabilities_of_all_tokens_sum_to_one(tokens):
    net = Network.start(tokens, 1, 2, 3, seed=2)
    net.word_bias[net.word_bias > -1] += 0.5
    every = np.arange(1, tokens)
    p = np.exp(net.log_probabilities(np.tile([[0, tokens - 1]], (tokens - 1, 1)), every))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_scores_are_sums_over_words(documents, odd):
    v = Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), 8)
    net = Network.start(v.size, 2, 4, 5, seed=1)
    rows = [*odd, (50, "one two three four five"), (51, "Red  green\nblue"), (52, "a long text of many words " * 40_000)]
    found = score_pseudo_likelihood(documents(rows, extra="n_words"), v, net).collect()
    assert len(found) == len(rows)
    for r in found:
        sums = []
        for text in [t for i, t in rows if i == r.doc_id]:
            (c,) = T.chunks(pa.array([text]))
            tokens = [0, 0, *v.encode(c, T.words(c, T.SPACED_WORDS, T.ASCII_LOWER))[0].tolist(), 0, 0]
            memo: dict = {}
            total = 0.0
            for i in range(2, len(tokens) - 2):
                key = (tokens[i - 2], tokens[i - 1], tokens[i + 1], tokens[i + 2], tokens[i])
                if key not in memo:
                    memo[key] = log_p(net, key[:4], key[4])
                total += memo[key]
            sums.append((len(tokens) - 4, total))
        assert any(r.n_words == n and math.isclose(r.log_likelihood, s, rel_tol=1e-5, abs_tol=1e-3) for n, s in sums)
        assert (r.per_word is None) == (r.n_words == 0)


def test_training_is_that_of_a_plain_loop(documents):
    """Two rounds over one shard of few words: a step each, on the mean gradient of the words of that part."""
    rows = [(i, " ".join(random.Random(i).choice(["red", "green", "blue"]) for _ in range(12))) for i in range(3)] + [(9, None)]
    docs = documents(rows)
    v = build_vocabulary(docs, frequent=2, buckets=2)
    assert v.size == 5 and v.shards == 1
    encoded = cut(encode(docs, v))
    got = train(encoded, v, rounds=2, width=2, units=3, rate=0.1)
    net = as_double(Network.start(v.size, 2, 2, 3))
    squares = [np.full(a.shape, 1e-8) for a in net.arrays()]
    table = [(r.place, np.frombuffer(r.tokens, np.uint16).tolist()) for r in encoded.collect()]
    for turn in range(2):
        pairs = []
        for place, tokens in table:
            padded = [0, 0, *tokens, 0, 0]
            for at in targets(np.array([place], np.int64).view(np.uint64), np.array([0, len(tokens)]), turn, 2).tolist():
                pairs.append(([padded[at], padded[at + 1], padded[at + 3], padded[at + 4]], tokens[at]))
        assert pairs
        for p, s, g in zip(net.arrays(), squares, differences(net, pairs), strict=True):
            s += g * g
            p -= 0.1 * g / (np.sqrt(s) + 1e-6)
    assert np.allclose(got.flat(), net.flat(), atol=2e-3)


def test_same_scores_under_any_partitioning(documents, monkeypatch):
    monkeypatch.setattr(L, "SHARD_WORDS", 1000)
    rng = random.Random(4)
    docs = documents([(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60))) for i in range(120)])
    v = build_vocabulary(docs, frequent=100, buckets=8)
    assert v.shards == 8
    found = []
    for parts in (3, 9):
        encoded = cut(encode(docs.repartition(parts), v))
        found.append({r.doc_id: r.per_word for r in score_encoded(encoded, train(encoded, v)).collect()})
    assert max(abs(found[0][i] - found[1][i]) for i in found[0]) < 1e-3
    assert len(set(found[0].values())) > 100


def test_training_helps_on_held_out_texts(documents):
    rng = random.Random(1)

    def text():
        out = []
        for _ in range(30):
            a = rng.randrange(6)
            out += [f"noun{a}", f"verb{a}", rng.choice(["red", "blue"])]
        return " ".join(out)

    docs, fresh = documents([(i, text()) for i in range(400)]), [(1000 + i, text()) for i in range(20)]
    shuffled = [(2000 + i, " ".join(rng.sample(t.split(), 90))) for i, t in fresh]
    v = build_vocabulary(docs, frequent=32, buckets=8)
    assert len(v.hashes) == 14
    net = train(cut(encode(docs, v)), v, rounds=4)
    start = Network.start(v.size, 2, 16, 32)
    mean = lambda n, rows: score_pseudo_likelihood(documents(rows), v, n).agg(F.avg("per_word")).first()[0]
    assert mean(net, fresh) > mean(start, fresh) + 1
    assert mean(net, fresh) > mean(net, shuffled) + 0.2


def test_training_helps_on_held_out_documents_of_the_corpus(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept, out = docs.filter("doc_id % 10 <> 0"), docs.filter("doc_id % 10 = 0 and n_chars > 200")
    v = build_vocabulary(kept)
    assert len(v.hashes) == 4032 and len(v.leaves) > 1000
    net = train(cut(encode(kept, v)), v)
    mean = lambda n: score_pseudo_likelihood(out, v, n).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    # The share of each token in the corpus, as a network whose only weights are its biases.
    shares = np.ones(v.size)
    for r in encode(kept, v).select("tokens").collect():
        shares += np.bincount(np.frombuffer(r.tokens, np.uint16), minlength=v.size)
    blind = Network.start(v.size, 2, 16, 32)
    blind.group[:], blind.word[:] = 0, 0
    k = blind.word_bias.shape[1]
    p = np.zeros(blind.word_bias.size)
    p[: v.size - 1] = shares[1:]
    with np.errstate(divide="ignore"):
        blind.word_bias[:] = np.maximum(np.log(p.reshape(-1, k)), -1e9)
        blind.group_bias[:] = np.log(p.reshape(-1, k).sum(axis=1))
        for b in (blind.word_bias, blind.group_bias):
            b -= b.max()
    assert mean(net) > mean(blind) + 0.3 > mean(Network.start(v.size, 2, 16, 32)) + 1


def test_empty(documents):
    docs = documents([])
    v = build_vocabulary(docs)
    net = train(encode(docs, v), v, rounds=1)
    assert np.array_equal(net.flat(), Network.start(v.size, 2, 16, 32).flat())
    assert score_pseudo_likelihood(docs, v, net).count() == 0


@pytest.mark.parametrize("side", [1, 3])
def test_contexts_stop_at_the_ends(side):
    got = contexts(np.array([5, 6, 7]), np.array([0, 2, 2, 3]), np.arange(3), side)
    assert got[:, side - 1].tolist() == [0, 5, 0] and got[:, side].tolist() == [6, 0, 0]


def test_rare_words_have_leaves_and_each_bucket_sums_to_one(documents):
    rows = [(i, f"the the the bation {'lotion' if i % 2 else 'the'} unique{i}ion") for i in range(12)]
    v = build_vocabulary(documents(rows), frequent=1, buckets=4)
    assert len(v.leaves) == 2  # bation, lotion; the others are found once
    assert v.words == 72
    (c,) = T.chunks(pa.array(["the bation lotion unique3ion neverseenion"]))
    tokens, within = v.encode(c, T.words(c, T.SPACED_WORDS, T.ASCII_LOWER))
    assert len(set(tokens[1:].tolist())) == 1 and tokens[0] == 1
    p = np.exp(within)
    assert p[0] == 1 and p[1:].tolist() == pytest.approx([12 / 31, 6 / 31, 1 / 31, 1 / 31])
    assert p[1] + p[2] + 13 * p[3] == pytest.approx(1)
    scored = score_pseudo_likelihood(documents([(1, "the bation the"), (2, "the lotion the"), (3, "the garbledion the")]), v, Network.start(v.size, 2, 4, 5))
    assert len({round(r.log_likelihood, 4) for r in scored.collect()}) == 3
    assert len(build_vocabulary(documents(rows), frequent=1, buckets=4, most_leaves=1).leaves) == 1


@pytest.mark.parametrize("rounds", [1, 3, 7])
def test_each_word_is_a_target_once(rounds):
    seeds, bounds = np.array([3, 4, 5], np.uint64), np.array([0, 400, 400, 402])
    got = [targets(seeds, bounds, turn, rounds) for turn in range(rounds)]
    assert sorted(np.concatenate(got).tolist()) == list(range(402))
    assert min(map(len, got)) > 402 / rounds / 2
