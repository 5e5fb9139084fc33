"""Token counts of a byte-level BPE by rank-synchronous merging of arrays.

Texts are cut into pre-tokens; those not met before are held as one ragged array of symbols. Each step finds the
lowest-rank adjacent pair of every sequence and merges all its occurrences in all sequences at once, until no sequence
has a pair that merges. What survives is counted. A merge only makes pairs of higher rank, so this is the order in
which the library merges.

Cost: one pass with no shuffle. A worker keeps the counts of short pre-tokens it has met, up to a bound.
"""

from __future__ import annotations

import json
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T

# The white space of Unicode, the pre-token pattern of byte-level BPE, and the bytes that stand for
# themselves in its vocabulary files (the others follow from code point 256 on).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

_KEEP_LENGTH, _KEEP_MANY = 64, 400_000
_NONE = np.int32(2**31 - 1)


def _check(spec: dict) -> None:
    """Files that ask for more than is done here are refused, so that no count is wrong."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wrong = {
        "model": model.get("type", "BPE") != "BPE",
        "pre_tokenizer": pre.get("type") != "ByteLevel" or not pre.get("use_regex", True),
        "add_prefix_space": bool(pre.get("add_prefix_space")),
        "normalizer": spec.get("normalizer") is not None,
        **{k: bool(model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
        "added_tokens": any(not t["special"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]),
    }
    if found := [k for k, bad in wrong.items() if bad]:
        raise ValueError(f"not supported in a vocabulary file: {', '.join(found)}")


class MergeTable:
    """Ranks and results of the merges of one vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        vocabulary = spec["model"]["vocab"]
        printed = set(PRINTED)
        rest = iter(range(256, 512))
        self.of_byte = np.array([vocabulary[chr(b if b in printed else next(rest))] for b in range(256)], np.int64)
        parts = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in parts], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in parts], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pretoken = regex.compile(PRETOKEN)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def count(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each (non-empty) sequence of bytes."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        out = np.zeros(len(sequences), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        active = np.arange(len(sequences))
        starts = np.cumsum(lengths) - lengths
        rank = self._pair_ranks(symbols, starts)
        while len(active):
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            out[active[done]] = lengths[done]
            if done.all():
                break
            if done.any():  # sequences with nothing to merge leave
                keep = np.repeat(~done, lengths)
                symbols, rank, active, lengths, least = symbols[keep], rank[keep], active[~done], lengths[~done], least[~done]
                starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            if len(hit) > 1:  # of a run of overlapping occurrences, every other one
                fresh = np.ones(len(hit), bool)
                fresh[1:] = hit[1:] != hit[:-1] + 1
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            lengths = lengths - np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(lengths))
            # Only pairs beside a merge change.
            place = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            starts = np.cumsum(lengths) - lengths
            at = place[hit]
            last = np.zeros(len(symbols), bool)
            last[starts + lengths - 1] = True
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched] = _NONE
            touched = touched[~last[touched]]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        return out

    def _pair_ranks(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
        rank[starts[1:] - 1] = _NONE
        return rank


class Counter:
    """Token counts of texts, with the counts of short pre-tokens kept between calls."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        special, cut = self.table.special, self.table.pretoken.findall
        extra = [0] * len(texts)
        split: list[list[str]] = []
        for i, text in enumerate(texts):
            if special is not None and special.search(text):
                segments = special.split(text)
                extra[i] = len(segments) - 1
                split.append([p for s in segments for p in cut(s)])
            else:
                split.append(cut(text))
        if len(self.known) > _KEEP_MANY:
            self.known.clear()
        new = list(set(chain.from_iterable(split)).difference(self.known))
        found = dict(zip(new, self.table.count([p.encode() for p in new]).tolist(), strict=True)) if new else {}
        self.known.update(found)
        count = self.known.__getitem__
        out = [sum(map(count, parts)) + more for parts, more in zip(split, extra, strict=True)]
        for p in new:
            if len(p) > _KEEP_LENGTH:
                del self.known[p]
        return out


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8) and n_tokens, as the library counts them for the file at path
    `vocabulary` (which every executor has), with no tokens added at the ends; special strings inside a text are one
    token each.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def count(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            for c in T.chunks(batch.column(1)):
                n = counter([c.text(i) for i in range(c.rows)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), pa.array(np.diff(c.offsets), pa.int64()), pa.array(n, pa.int64())], names=["_id", "n_bytes", "n_tokens"]
                )

    return source.mapInArrow(count, f"_id {kind}, n_bytes long, n_tokens long").withColumnRenamed("_id", id_col)
