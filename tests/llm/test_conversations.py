import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest

from quillgraph.llm.conversations import END, START, costs_to_go, damaged, repair_conversations, repair_digests, walk

GRAMMAR = re.compile("(s?(ua)+)?")


def every_repair(codes):
    """All edits of a few turns, by trying them: the least (cost, audit), and the roles it gives."""
    gaps = [list(w) for n in range(3) for w in product("ua", repeat=n)]
    best = None
    for inserts in product(gaps, repeat=len(codes) + 1):
        for edits in product("DKR", repeat=len(codes)):
            if any(c[1] and e != "D" for c, e in zip(codes, edits, strict=True)):
                continue
            for new in product("ua", repeat=edits.count("R")):
                audit, roles, cost, made = "I" * len(inserts[0]), "".join(inserts[0]), 2 * sum(map(len, inserts)), iter(new)
                for (initial, _, short), e, more in zip(codes, edits, inserts[1:], strict=True):
                    audit += e + "I" * len(more)
                    roles += {"D": "", "K": initial or "?", "R": next(made) if e == "R" else ""}[e] + "".join(more)
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (short and e != "D")
                if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, roles)
    return best


CODES = [(i, gone, short) for i in ("s", "u", "a", " ", "") for gone, short in ((False, False), (True, False), (False, True))]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_against_every_repair(n):
    for codes in product(CODES, repeat=n):
        codes = list(codes)
        costs = costs_to_go(codes, END)
        edits, state = walk(codes, costs, START, last=True)
        assert (costs[0][START], "".join(e for e, _ in edits)) == every_repair(codes)[:2], codes
        assert state in (0, 3)


def plain_python(rows):
    """Counts, cost, audit and hash of turns (turn, role, text) in order, by the least of costs and audits from each turn on."""
    codes, seen, lines = [], set(), []
    n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for k, (_, role, text) in enumerate(rows):
        bare = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        n["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserts):
        found = []
        if i == len(codes) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 2:
            found += [(2 + c, "I" + a, (("I", x), *e)) for x in states[state] if x != "s" for c, a, e in [best(i, states[state][x], inserts + 1)] if c < 1 << 40]
        if i < len(codes):
            initial, gone, short = codes[i]
            options = [("D", 3, None)]
            if not gone:
                options += [("K", short, initial)] if initial in states[state] else []
                options += [("R", 2 + short, x) for x in states[state] if x != "s"]
            for letter, cost, x in options:
                c, a, e = best(i + 1, states[state][x] if x else state, 0)
                found.append((cost + c, letter + a, ((letter, x), *e)))
        return min(found, default=(1 << 50, "", ()))

    for i in range(len(codes), -1, -1):  # so that the recursion stays shallow
        for s in states:
            best(i, s, 0)
    cost, audit, edits = best(0, "", 0)
    at = 0
    for letter, x in edits:
        if letter != "I":
            at += 1
        if letter != "D":
            role = rows[at - 1][1] if letter == "K" else {"u": "user", "a": "assistant"}[x]
            lines.append(f"{role}:{'' if letter == 'I' else rows[at - 1][2]}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *n.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def grouped(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return out


def digests(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def table(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, _conv int")


def random_table(sizes):
    rng = random.Random(len(sizes))
    texts = [None if rng.random() < 0.03 else rng.choice(["Done", "Really", "cut", "\xa0", "été"]) + str(rng.randint(0, 40)) + rng.choice([".", "?", "", " \n", ".\t"]) for _ in range(sum(sizes.values()))]
    rows, at = [], 0
    for conv, n in sizes.items():
        for _ in range(n):
            rows.append((conv, rng.choice([None, *range(2 * n)]), rng.choices(["system", "user", "assistant", "tool", "", None], [1, 5, 5, 1, 0.2, 0.2])[0], texts[at] if rng.random() < 0.9 else rng.choice(["", " \n"])))
            at += 1
    return rows


@pytest.mark.parametrize("sizes", [{i: i % 9 for i in range(60)}, {None: 300, 1: 5, 2: 1, 3: 700, 4: 3}, {5: 900}])
def test_whole_tables(spark, sizes, many_ranges):
    rows = random_table(sizes)
    want = {conv: plain_python(in_order(turns)) for conv, turns in grouped(rows).items()}
    assert digests(repair_digests(table(spark, rows))) == want


def test_a_long_conversation_lies_in_parts_that_join(spark, many_ranges):
    rows = random_table({3: 700, 9: 2})
    out = repair_conversations(table(spark, rows)).collect()
    parts = sorted((r for r in out if r.conv_id == 3), key=lambda r: r.part)
    assert len(parts) == parts[0].parts > 1 and [r.part for r in parts] == list(range(len(parts))) and len({r.cost for r in parts}) == 1
    roles = "".join(x.role[:1] for r in parts for x in r.repaired)
    assert GRAMMAR.fullmatch(roles)
    assert "".join(r.audit for r in parts) == digests(repair_digests(table(spark, rows)))[3][6]


def test_repeats_of_one_row(spark, many_ranges):
    rows = [(1, 4, "user", "Same.")] * 400 + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Yes.")]
    want = {conv: plain_python(in_order(turns)) for conv, turns in grouped(rows).items()}
    assert want[1][2] == 399 and digests(repair_digests(table(spark, rows))) == want


def test_damage(spark):
    rows = [(c, t, role, text) for c in (*range(60), None) for t, role, text in [(0, "system", "Be. Good!"), (1, "user", "a?b"), (2, None, None), (None, "assistant", "Ja. Nein.")]]
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    hurt = damaged(table(spark, rows))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r)[:4] for r in hurt.filter("present").collect()), key=key) == sorted(want, key=key)
    got, there = digests(repair_digests(hurt, present="present")), grouped(want)
    assert set(got) == {r[0] for r in rows}
    assert got == {c: plain_python(in_order(there.get(c, []))) for c in got}


def test_odd_tables(spark):
    assert repair_digests(table(spark, [])).count() == 0 and repair_conversations(table(spark, [])).count() == 0
    dropped = table(spark, [(1, 1, "user", "x"), (1, 2, "user", "y")]).selectExpr("*", "false as present")
    assert digests(repair_digests(dropped, present="present")) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = "word " * 500_000
    rows = [(1, 1, "user", long), (1, 2, "assistant", "Ok.")]
    assert digests(repair_digests(table(spark, rows)))[1] == plain_python([r[1:] for r in rows])

