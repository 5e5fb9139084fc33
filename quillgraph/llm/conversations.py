"""Cheapest repairs of conversations whose turns are blank, repeated, cut off or out of order.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn. Edits keep, rerole,
delete or insert turns. Backward dynamic programming gives the cost to go for each turn and grammar state; a walk forward
takes the ASCII-least of the edits that lose nothing against it. The grammar gives each edit one next state, so that the
walk's choice is the least of all cheapest repairs.

Groups of any size: turns are sorted in ranges over the whole table, so that a long conversation lies in several tasks.
A range's part of a conversation is a (min, +) matrix of costs from state to state. The matrices of conversations that lie
in more than one range (at most two parts for each range) are multiplied on the driver, which gives each part the costs to
go behind it; a second pass tells at which state each of the four would leave the part, and a third makes the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.operators.ordered import fold_groups
from quillgraph.session import cut

INF = 1 << 60
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # the grammar's states, named for the last turn
ENDS = (0, INF, INF, 0)  # START and ASSISTANT may end a conversation
#: The state after a new user or assistant turn, which is the only one of the two that the grammar takes.
_NEW = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
Costs = tuple[int, int, int, int]
#: (initial of the role, must go, is cut off) of a turn.
Code = tuple[str, bool, bool]


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return _NEW[state] if initial == "ua"[_NEW[state] - USER] else None


def _with_inserts(w: list[int]) -> Costs:
    user = min(w[USER], INSERT + w[ASSISTANT])
    assistant = min(w[ASSISTANT], INSERT + w[USER])
    return min(w[START], INSERT + user), min(w[SYSTEM], INSERT + user), user, assistant


def _edits(state: int, code: Code) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn in ASCII order, insertion aside: letter, cost, next state."""
    initial, gone, short = code
    yield "D", DELETE, state
    if not gone:
        if (to := _kept(state, initial)) is not None:
            yield "K", KEEP + TRUNCATED * short, to
        yield "R", REROLE + TRUNCATED * short, _NEW[state]


def cost_before(code: Code, after: Costs) -> Costs:
    """Costs to go before a turn, given those after it."""
    return _with_inserts([min(c + after[to] for _, c, to in _edits(s, code)) for s in range(4)])


def costs_to_go(codes: list[Code], end: Costs) -> list[Costs]:
    """Before each turn, and behind the last; `end` are the costs behind it, with insertions."""
    out = [end]
    for code in reversed(codes):
        out.append(cost_before(code, out[-1]))
    return out[::-1]


END = _with_inserts(list(ENDS))


def walk(codes: list[Code], costs: list[Costs], state: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """The ASCII-least cheapest edits from `state`, each with the state it leads to; and the state behind the turns.
    Insertions behind the last turn of a part belong to it only where it is the conversation's `last`."""
    out: list[tuple[str, int]] = []

    def inserted(i: int) -> bool:
        nonlocal state
        to = _NEW[state]
        if INSERT + costs[i][to] != costs[i][state]:
            return False
        out.append(("I", to))
        state = to
        return True

    for i, code in enumerate(codes):
        while True:
            tight = [e for e in _edits(state, code) if e[1] + costs[i + 1][e[2]] == costs[i][state]]
            if tight and tight[0][0] == "D" or not inserted(i):
                break
        letter, _, state = tight[0]
        out.append((letter, state))
    while last and costs[-1][state]:
        inserted(len(codes))
    return out, state


def is_blank(text: str) -> bool:
    return not text.strip(" \t\n\v\f\r")


def is_cut_off(text: str) -> bool:
    return text.rstrip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")


@dataclass
class Part:
    """A conversation, or what one range has of it."""

    codes: list[Code] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    first: Any = None
    last: Any = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, turn: Any, role: str, text: str, duplicate: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        blank = is_blank(text)
        duplicate &= not blank
        short = not blank and not duplicate and is_cut_off(text)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += short
        if self.codes and self.codes[-1][0] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.codes.append((role[:1], blank or duplicate, short))
        self.roles.append(role)
        self.texts.append(text)

    def repaired(self, edits: list[tuple[str, int]]) -> list[dict[str, str]]:
        out, at = [], 0
        for letter, state in edits:
            if letter == "I":
                out.append({"role": _ROLE[state], "text": ""})
                continue
            if letter != "D":
                out.append({"role": self.roles[at] if letter == "K" else _ROLE[state], "text": self.texts[at]})
            at += 1
        return out


def _part(rows: Iterable[dict[str, Any]], flagged: bool) -> Part:
    """flagged: repeats are marked in the rows, as they may repeat those of another range."""
    part, seen = Part(), set()
    for r in rows:
        if r["_role"] is not None:
            part.add(r["_turn"], r["_role"], r["_body"], r["_again"] if flagged else (r["_role"], r["_body"]) in seen)
            seen.add((r["_role"], r["_body"]))
    return part


def _matrix(codes: list[Code]) -> list[Costs]:
    """Column t: costs from each state before the turns to state t behind them, before any insertion there."""
    out = []
    for t in range(4):
        v: Costs = tuple(0 if s == t else INF for s in range(4))
        for code in reversed(codes):
            v = tuple(min(x, INF) for x in cost_before(code, v))
        out.append(v)
    return out


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_TOTALS = ["gaps", *_COUNTS, "cost"]


@dataclass
class _Known:
    """What the driver tells a part: number among its conversation's, parts of that, costs behind, state before, totals."""

    number: int
    of: int
    costs: Costs
    state: int = START
    totals: tuple = ()


def _totals(parts: list[dict[str, Any]]) -> tuple[int, ...]:
    """gaps, and the counts, of a conversation in parts."""
    some = [p for p in parts if p["n"]]
    dated = [p for p in some if p["turns"]]
    gaps = 0
    if dated:
        shared = sum(a["last"] == b["first"] for a, b in zip(dated, dated[1:], strict=False))
        gaps = dated[-1]["last"] - dated[0]["first"] + 1 - sum(p["turns"] for p in dated) + shared
    seams = sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(some, some[1:], strict=False))
    blank, duplicate, truncated, illegal = (sum(p[k] for p in parts) for k in _COUNTS)
    return gaps, blank, duplicate, truncated, illegal + seams


def _summary(part: Part) -> dict[str, Any]:
    return {
        "n": len(part.codes), "turns": part.turns, "first": part.first, "last": part.last, "head": part.codes[0][0] if part.codes else "", "tail": part.codes[-1][0] if part.codes else "",
        "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated, "illegal": part.illegal,
    }


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None
) -> DataFrame:
    """Repairs every conversation: rows of a null id are one. Turns are taken by number (nulls first), those of one number
    by role and SHA-256 of the text. Null roles and texts are one space (no role, and blank). `present`: a boolean column;
    rows where it isn't true only tell that their conversation exists.

    Returns a row for each part of a conversation: id, part (from 0), parts (one but for conversations that lie over
    ranges of the sort), gaps, blank, duplicate, truncated, illegal and cost of the whole conversation, and audit and
    repaired (array of role and text) of the part. Other columns are ignored; no rows give none.
    """
    done, parts = _repaired(turns, conv_col, turn_col, role_col, text_col, present)
    return (done if parts is None else done.unionByName(parts)).withColumnRenamed("_conv", conv_col)


def repair_digests(turns: DataFrame, conv_col: str = "conv_id", present: str | None = None) -> DataFrame:
    """As repair_conversations, but a row for each conversation, with its whole audit and `repaired_sha256`, the SHA-256
    of its repaired turns as lines `role:text`. The parts of a conversation stream through one task, as the hash asks."""
    done, parts = _repaired(turns, conv_col, "turn", "role", "text", present)
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    kept = ["_conv", *_TOTALS, "audit"]
    out = done.select(*kept, F.sha2(lines, 256).alias("repaired_sha256"))
    if parts is not None:

        def fold(key, rows):
            audit, digest, between = [], hashlib.sha256(), b""
            for r in rows:
                audit.append(r["audit"])
                for x in r["repaired"]:
                    digest.update(between + f"{x['role']}:{x['text']}".encode())
                    between = b"\n"
            yield key[0], *[r[c] for c in _TOTALS], "".join(audit), digest.hexdigest()

        kind = out.schema["_conv"].dataType.simpleString()
        schema = f"_conv {kind}, {', '.join(f'{c} long' for c in _TOTALS)}, audit string, repaired_sha256 string"
        out = out.unionByName(fold_groups(parts, ["_conv"], ["part"], fold, schema))
    return out.withColumnRenamed("_conv", conv_col)


def _repaired(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: str | None) -> tuple[DataFrame, DataFrame | None]:
    """Conversations that lie in one range, and the parts of the others, if there are any."""
    spark = turns.sparkSession
    there = F.col(present) if present else F.lit(True)
    source = turns.select(
        F.col(conv_col).alias("_conv"), F.when(there, F.col(turn_col).cast("long")).alias("_turn"), F.when(there, F.coalesce(F.col(role_col).cast("string"), F.lit(" "))).alias("_role"),
        F.when(there, F.coalesce(F.col(text_col).cast("string"), F.lit(" "))).alias("_body"),
    )
    id_type = source.schema["_conv"].dataType.simpleString()
    keys = ["_conv", "_turn", "_role", "_sha", "_row"]
    dealt = source.withColumns({"_sha": F.unhex(F.sha2("_body", 256)), "_row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_sha")
    dealt = cut(dealt.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))

    # A conversation that ends one range and begins the next lies in both.
    ends = sorted(dealt.groupBy("_range").agg(F.min(F.struct("_conv")).alias("a"), F.max(F.struct("_conv")).alias("b")).collect(), key=lambda r: r["_range"])
    over = list(dict.fromkeys(x.b[0] for x, y in zip(ends, ends[1:], strict=False) if x.b[0] == y.a[0]))
    split = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(over)], f"_key {id_type}, _which int"))  # at most one for each range
    mine = F.col("_conv").eqNullSafe(F.col("_key"))

    out = f"_conv {id_type}, part int, parts int, {', '.join(f'{c} long' for c in _TOTALS)}, audit string, repaired array<struct<role: string, text: string>>"

    def whole(rows: Iterator[dict[str, Any]]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r["_conv"]):
            part = _part(group, flagged=False)
            costs = costs_to_go(part.codes, END)
            edits, _ = walk(part.codes, costs, START, last=True) if part.codes else ([], START)
            yield conv, 0, 1, *_totals([_summary(part)]), costs[0][START], "".join(e for e, _ in edits), part.repaired(edits)

    done = _in_order(dealt.join(split, mine, "left_anti"), whole, out)
    if not over:
        return done, None

    parts = dealt.join(split, mine).withColumn("_sha", F.sha2("_body", 256))
    again = parts.filter(F.col("_role").isNotNull()).groupBy("_which", "_role", "_sha").agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    parts = cut(parts.join(again, ["_which", "_role", "_sha"], "left").withColumn("_again", F.coalesce(F.col("_row") > F.col("_first"), F.lit(False))).select("_conv", "_which", "_range", "_turn", "_role", "_body", "_row", "_again"))

    def per_part(what: Callable[[tuple[int, int], Part, Any], Iterable[tuple]], schema: str) -> DataFrame:
        def fold(key, rows):
            first = next(rows)
            part = _part((r for group in ([first], rows) for r in group), flagged=True)
            yield from what(key, part, first["_conv"])

        return fold_groups(parts, ["_which", "_range"], ["_row"], fold, schema)

    known = _composed(per_part)

    def finish(key, part, conv):
        k = known[key]
        edits, _ = walk(part.codes, costs_to_go(part.codes, k.costs), k.state, last=k.number == k.of - 1)
        yield conv, k.number, k.of, *k.totals, "".join(e for e, _ in edits), part.repaired(edits)

    return done, per_part(finish, out)


def _in_order(rows: DataFrame, each: Callable[[Iterator[dict[str, Any]]], Iterator[tuple]], schema: str) -> DataFrame:
    """What `each` makes of the rows of a partition, streamed in the order that they have."""
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for made in each(r for b in batches for r in b.to_pylist()):
            out.append(made)
            if len(out) == 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _composed(per_part: Callable[..., DataFrame]) -> dict[tuple[int, int], _Known]:
    """For each part of a conversation: the costs behind it, the state before it, and the conversation's totals."""

    def measure(key, part, conv):
        s = _summary(part)
        yield *key, *[x for column in _matrix(part.codes) for x in column], *s.values()

    cells = [f"m{i}" for i in range(16)]
    kinds = {"first": "long", "last": "long", "head": "string", "tail": "string"}
    names = ["n", "turns", "first", "last", "head", "tail", *_COUNTS]
    rows = per_part(measure, f"_which int, _range int, {', '.join(f'{c} long' for c in cells)}, {', '.join(f'{n} {kinds.get(n, "long")}' for n in names)}").collect()
    known: dict[tuple[int, int], _Known] = {}
    groups = [list(g) for _, g in groupby(sorted(rows, key=lambda r: (r["_which"], r["_range"])), key=lambda r: r["_which"])]
    for group in groups:
        after, totals = END, _totals([r.asDict() for r in group])
        for number in range(len(group) - 1, -1, -1):
            r = group[number]
            known[r["_which"], r["_range"]] = _Known(number, len(group), after)
            if r["n"]:
                after = tuple(min(r[f"m{4 * t + s}"] + after[t] for t in range(4)) for s in range(4))
        for r in group:
            known[r["_which"], r["_range"]].totals = (*totals, after[START])

    def leave(key, part, conv):
        k = known[key]
        costs = costs_to_go(part.codes, k.costs)
        yield *key, *[walk(part.codes, costs, s, last=False)[1] if costs[0][s] < INF else s for s in range(4)]

    exits = {(r[0], r[1]): r[2:] for r in per_part(leave, "_which int, _range int, e0 int, e1 int, e2 int, e3 int").collect()}
    for group in groups:
        state = START
        for r in group:
            key = r["_which"], r["_range"]
            known[key].state = state
            state = exits[key][state]
    return known


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage to conversations by a hash of id and turn: rows dropped (they stay, with `present` false),
    emptied, without their ends of sentences, repeated, or of the user."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") != 0).alias("present"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")
