import math
import random

import pytest

from quillgraph.llm.mixing import mix_sources


def exponent(totals, entropy_share, max_repeats, budget):
    """Plain bisection over the shares."""
    whole = sum(totals.values())
    p = [v / whole for v in totals.values()]

    def weights(a):
        s = sum(x**a for x in p)
        return [x**a / s for x in p]

    def bisect(holds):
        lo, hi = 0.0, 1.0
        if holds(1.0):
            return 1.0
        if not holds(0.0):
            return 0.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds(mid) else (lo, mid)
        return lo

    def repeats(a):
        r = [w / x for w, x in zip(weights(a), p, strict=True)]
        return max(r) / min(r) if budget is None else max(r) * budget

    level = bisect(lambda a: -sum(w * math.log(w) for w in weights(a)) >= entropy_share * math.log(len(p)))
    cap = 0.0 if repeats(0.0) <= max_repeats else bisect(lambda a: repeats(a) > max_repeats)
    return dict(zip(totals, weights(max(level, cap)), strict=True))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    sources = ["big"] * 600 + ["mid"] * 120 + ["low"] * 30 + [None] * 20
    return [(i, " ".join(["w"] * rng.randint(0, 40)), "en", s) for i, s in enumerate(sources)]


@pytest.mark.parametrize(("entropy_share", "max_repeats", "budget"), [(0.8, 4.0, None), (0.95, 50.0, None), (0.9, 3.0, 0.5), (0.1, 4.0, None), (0.99, 2.0, 2.0)])
def test_weights_and_uses(documents, corpus, entropy_share, max_repeats, budget):
    totals, size = {}, {}
    for i, text, _, s in corpus:
        size[i] = len(text.split())
        totals[s] = totals.get(s, 0) + size[i]
    want = exponent(totals, entropy_share, max_repeats, budget)
    whole = sum(totals.values())
    tokens = whole * budget if budget else max(totals[s] / want[s] for s in totals)
    uses: dict = {}
    got: dict = {s: 0 for s in totals}
    for r in mix_sources(documents(corpus), entropy_share=entropy_share, max_repeats=max_repeats, budget_share=budget, block_tokens=200, most_broadcast=2 if budget else 1000).collect():
        uses.setdefault(r.doc_id, []).append(r.epoch)
        got[r.source] += r.n_tokens
        assert r.n_tokens == size[r.doc_id] and 0 <= r.slot <= 1
    for s in totals:  # a document that doesn't fit is left out at the end of the budget
        assert want[s] * tokens - 45 <= got[s] <= want[s] * tokens * 1.001 + 1
    for i, epochs in uses.items():
        assert sorted(epochs) == list(range(len(epochs)))
        assert abs(len(epochs) - want[corpus[i][3]] * tokens / totals[corpus[i][3]]) < 1.01
    if budget is None:
        assert len(uses) == len(corpus)


def test_same_every_time_and_odd_rows(documents, odd):
    a = sorted(map(str, mix_sources(documents(odd, extra="block")).collect()))
    assert a == sorted(map(str, mix_sources(documents(odd, extra="block")).collect())) and len(a) == len(odd)
    assert mix_sources(documents([])).count() == 0
    assert mix_sources(documents([(1, None, None, "a"), (2, "", None, "b")])).count() == 2  # no tokens: once each
