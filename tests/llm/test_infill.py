import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.infill import Boundaries, fill_in_middle, restored


@pytest.mark.parametrize("n, share", [(0, 0.5), (1, 1.0), (63, 0.3), (64, 0.3), (512, 0.01), (513, 1.0), (5000, 0.0), (20_000, 0.02)])
def test_rank_and_select(n, share):
    bits = np.random.default_rng(n).random(n) < share
    b, ones = Boundaries(bits), np.flatnonzero(bits)
    assert b.total == len(ones)
    assert b.rank(np.arange(n + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert b.select(np.arange(1, len(ones) + 1)).tolist() == ones.tolist()


def plain_python(doc_id, text, seed=7, percent=100, suffix_first=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows, **how):
    out = fill_in_middle(docs, **how).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in out)
    want = sorted((str(i), n, form, str(p), str(m), o, t or "") for i, t in rows for n, form, p, m, o in [plain_python(i, t, **how)])
    assert got == want


def test_against_plain_python(documents):
    rng = random.Random(3)
    lines = ["", "a", "über\r", "😀 x", "<S", ">", "<M>" * 0, "long " * 40]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(1000, "a <M> b"), (1001, "<P>"), (1002, "\n" * 99), (-5, "x\ny"), (1003, "a\n" * 400_000 + "é")]
    check(documents(rows), rows)
    check(documents(rows), rows, seed=8, percent=30, suffix_first=80)


def test_odd_rows(documents, odd):
    check(documents(odd, extra="output"), odd)
    assert fill_in_middle(documents([])).count() == 0


@pytest.mark.parametrize("sentinels", [("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("<P>", "x<P>y", "<M>"), ("", "b", "c"), ("aba", "x", "y")])
def test_sentinels_that_could_be_mistaken_are_refused(documents, sentinels):
    with pytest.raises(ValueError, match="sentinels"):
        fill_in_middle(documents([]), sentinels=sentinels)


def test_other_sentinels(documents):
    s = ("[pre.]", "[suf|]", "[mid+]")
    (r,) = fill_in_middle(documents([(1, "a\nb\nc")]), sentinels=s).withColumn("back", restored(F.col("output"), F.col("form"), s)).collect()
    assert r.back == "a\nb\nc" and all(x in r.output for x in s)
