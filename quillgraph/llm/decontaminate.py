"""Benchmark decontamination by winnowing.

Both sides keep the smallest 5-gram hash of every window of ten words. Two texts that share ten consecutive words
have one whole window in common, and so the same smallest hash there: no shared window can be missed. A document
window whose fingerprint also occurs in the benchmark is compared as a whole (hash of all ten words), and matching
windows that overlap grow into spans.

Cost: one pass over the documents with no shuffle for each block of benchmark windows. The index of a block is sent
to the executors; its size is counted first and bounded by `block_words`. Items beyond it make further blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T
from quillgraph.session import cut

_TABLE_BITS = 22


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


@dataclass
class _Lookup:
    """Sorted distinct hashes, and for each the numbers of the items that have it."""

    hashes: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    table: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slots(self.hashes)] = True

    def __getstate__(self):
        return self.hashes, self.starts, self.items

    def __setstate__(self, state):
        self.hashes, self.starts, self.items = state
        self.__post_init__()

    @classmethod
    def of(cls, hashes: np.ndarray, items: np.ndarray) -> _Lookup:
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        hashes, items = hashes[fresh], items[fresh]
        unique, starts = np.unique(hashes, return_index=True)
        return cls(unique, np.append(starts, len(hashes)), items)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h occur (positions in h), and at which entry."""
        maybe = np.flatnonzero(self.table[_slots(h)])
        entry = np.searchsorted(self.hashes, h[maybe])
        entry[entry == len(self.hashes)] = 0
        sure = self.hashes[entry] == h[maybe] if len(self.hashes) else np.zeros(len(maybe), bool)
        return maybe[sure], entry[sure]


def _window_minima(h5: np.ndarray, span: int) -> np.ndarray:
    """Smallest of each `span` neighbours."""
    out, have = h5, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _fingerprints(w: T.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of every whole window."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(w.hash) - gram + 1, np.uint64)
    for j in range(gram):
        h = h * T._GRAM + w.hash[j : j + len(h)]
    least = _window_minima(T.mix(h), window - gram + 1)
    at = np.flatnonzero(w.row[:n] == w.row[window - 1 :])
    return at, least[at]


class Index:
    """Fingerprints and windows of one block of benchmark pieces; items shorter than a window by their whole length."""

    def __init__(self, pieces: list[tuple[str | None, np.ndarray, bool]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.names = sorted({name for name, _, _ in pieces if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        hashes = [h for _, h, _ in pieces]
        bounds = np.cumsum([0, *map(len, hashes)])
        w = T.Words(np.repeat(np.arange(len(pieces)), np.diff(bounds)), None, None, np.concatenate([*hashes, np.zeros(0, np.uint64)]), bounds)
        item = np.array([number.get(name, -1) for name, _, _ in pieces], np.int64)
        self.prints = np.unique(_fingerprints(w, window, gram)[1])
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slots(self.prints)] = True
        at, h = T.grams(w, window)
        self.by_length = {window: _Lookup.of(h, item[w.row[at]])}
        for m in range(1, window):
            short = [i for i, (_, h, whole) in enumerate(pieces) if whole and len(h) == m]
            if short:
                self.by_length[m] = _Lookup.of(np.array([T.run_hash(hashes[i]) for i in short], np.uint64), item[short])

    def hits(self, w: T.Words) -> Iterator[tuple[int, np.ndarray, _Lookup, np.ndarray]]:
        """Length, starts, lookup and its entries of all occurrences of windows."""
        at, prints = _fingerprints(w, self.window, self.gram)
        maybe = np.flatnonzero(self.table[_slots(prints)])
        entry = np.searchsorted(self.prints, prints[maybe])
        entry[entry == len(self.prints)] = 0
        at = at[maybe[self.prints[entry] == prints[maybe]]] if len(self.prints) else at[:0]
        h = np.full(len(at), np.uint64(self.window))
        for j in range(self.window):
            h = h * T._GRAM + w.hash[at + j]
        found, entry = self.by_length[self.window].find(T.mix(h))
        yield self.window, at[found], self.by_length[self.window], entry
        for m, lookup in self.by_length.items():
            if m < self.window:
                at, h = T.grams(w, m)
                found, entry = lookup.find(h)
                yield m, at[found], lookup, entry


_FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _scan(index: Index, carried: list[str], only_hits: bool):
    """The pass over documents (text first): carried columns, word count, hit spans (in words) and items."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def scan(batches):
        for batch in batches:
            for c in T.chunks(batch.column(0)):
                w = T.words(c, T.ALNUM_WORDS, T.ASCII_LOWER)
                cover = np.zeros(len(w.hash) + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for m, at, lookup, entry in index.hits(w):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + m, -1)
                    n = lookup.starts[entry + 1] - lookup.starts[entry]
                    row = np.repeat(w.row[at], n)
                    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.unique(np.column_stack([row, lookup.items[np.repeat(lookup.starts[entry], n) + inner]]), axis=0))
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.ones(len(hit) + 1, bool)  # a span begins where a hit word follows a miss or another row
                edge[1:-1] = (hit[1:] != hit[:-1]) | (w.row[1:] != w.row[:-1])
                cuts = np.flatnonzero(edge)
                lo, hi = cuts[:-1][hit[cuts[:-1]]] if len(hit) else cuts[:0], cuts[1:][hit[cuts[:-1]]] if len(hit) else cuts[:0]
                of = w.row[lo] if len(lo) else lo
                pairs = np.unique(np.concatenate(pairs), axis=0)
                pairs = pairs[pairs[:, 1] >= 0]
                rows = np.arange(c.rows)
                if only_hits:
                    rows = np.unique(of)
                spans_at = np.append(np.searchsorted(of, rows), len(of)).astype(np.int32)
                items_at = np.append(np.searchsorted(pairs[:, 0], rows), len(pairs)).astype(np.int32)
                base = w.bounds[of] if len(of) else of
                cols = {
                    "n_words": pa.array(np.diff(w.bounds)[rows], pa.int64()),
                    "spans": pa.ListArray.from_arrays(spans_at, pa.StructArray.from_arrays([pa.array(lo - base, pa.int32()), pa.array(hi - base, pa.int32())], fields=list(span))),
                    "items": pa.ListArray.from_arrays(items_at, pa.array([index.names[i] for i in pairs[:, 1]], pa.string())),
                }
                same = [batch.column(i + 1).slice(c.first, c.rows).take(pa.array(rows)) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*same, *cols.values()], names=[*carried, *cols])

    return scan


def _pieces(window: int, size: int):
    """Word hashes of the items, in pieces of bounded length that overlap so that every window is whole in one."""

    def cut_up(batches):
        for batch in batches:
            out = []
            for c in T.chunks(batch.column(1)):
                w = T.words(c, T.ALNUM_WORDS, T.ASCII_LOWER)
                for r in range(c.rows):
                    lo, hi = int(w.bounds[r]), int(w.bounds[r + 1])
                    name = batch.column(0)[c.first + r].as_py()
                    for at in range(lo, max(hi - window + 1, lo + (hi > lo)), size):
                        out.append((name, w.hash[at : min(at + size + window - 1, hi)].tobytes(), hi - lo < window))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.bool_()))], names=["item", "hashes", "short"])

    return cut_up


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_words: int = 2_000_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_words, spans (of words that lie in an occurrence of a
    window; ends exclusive, sorted, disjoint) and items (ids as strings, distinct, sorted) whose windows occur.

    Null or empty texts have no words and no hits; items without words are ignored. Items whose id is null take part
    in spans but are not listed. Repeated rows, ids and items each count as they stand. Other columns are ignored, and
    may have any names. With an empty benchmark every document is clean.
    """
    names = [id_col, *(keep or [])]
    carried = [f"_k{i}" for i in range(len(names))]
    source = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(k) for c, k in zip(names, carried, strict=True)])
    types = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in carried)
    pieces = cut(
        benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
        .mapInArrow(_pieces(window, 1 << 15), "item string, hashes binary, short boolean")
        .dropDuplicates()
    )
    total = pieces.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    blocks = max(1, int(-(-total // block_words)))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)))

    def block_index(i: int) -> Index:
        rows = pieces.filter(F.col("block") == i).select("item", "hashes", "short").collect()  # bounded by block_words
        return Index([(r.item, np.frombuffer(bytes(r.hashes), np.uint64), r.short) for r in rows], window, gram)

    back = [F.col(k).alias(c) for c, k in zip(names, carried, strict=True)]
    if blocks == 1:
        return source.mapInArrow(_scan(block_index(0), carried, False), f"{types}, {_FOUND}").select(*back, "n_words", "spans", "items")
    id_type = source.schema["_k0"].dataType.simpleString()
    keyed = source.select("_text", "_k0", F.xxhash64("_text").alias("_key"))
    parts = None
    for i in range(blocks):
        part = keyed.mapInArrow(_scan(block_index(i), ["_k0", "_key"], True), f"_k0 {id_type}, _key long, {_FOUND}")
        parts = part if parts is None else parts.unionByName(part)
    union = F.pandas_udf(_merge_spans, "array<struct<start:int,end:int>>")
    merged = parts.groupBy("_k0", "_key").agg(
        union(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    counts = source.withColumn("_key", F.xxhash64("_text")).mapInArrow(_counted(len(carried) + 1), f"{types}, _key long, n_words long")
    return (
        counts.alias("a")
        .join(merged.alias("b"), F.col("a._k0").eqNullSafe(F.col("b._k0")) & (F.col("a._key") == F.col("b._key")), "left")
        .select(
            *[F.col(f"a.{k}").alias(c) for c, k in zip(names, carried, strict=True)],
            "a.n_words",
            F.coalesce("b.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            F.coalesce("b.items", F.array().cast("array<string>")).alias("items"),
        )
    )


def _counted(carried: int):
    def count(batches):
        for batch in batches:
            for c in T.chunks(batch.column(0)):
                n = np.diff(T.words(c, T.ALNUM_WORDS, T.ASCII_LOWER).bounds)
                same = [batch.column(i + 1).slice(c.first, c.rows) for i in range(carried)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "n_words"])

    return count


def _merge_spans(column: pd.Series) -> pd.Series:
    def merged(spans):
        out: list[dict] = []
        for s in sorted(spans, key=lambda s: s["start"]):
            if out and s["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], s["end"])
            else:
                out.append(dict(s))
        return out

    return column.map(merged)
