"""Quality rules: base counts of words, symbols and repeats, and distribution divergence from language references.

A reference is the histogram of character classes and of common words, summed over all documents of one language
label that are long enough. A document is kept if, for some reference, the Jensen-Shannon distances (base 2, 0 to 1) of
both histograms are small. Short documents have too few counts to judge and pass; base rules hold for all.

Cost: one pass that sums histograms (each task sends one row for each label and bin), one pass that judges; no other
shuffle. The references sent to executors have about a hundred counts for each label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T

# Common words of some languages, in lower case.
COMMON_WORDS = (
    "the of and to in is that it for was with as on be at by this from or an are not "
    "le la les de des et un une du en que qui dans pour par sur est pas au avec "
    "der die das und ein eine nicht mit von zu den ist im auf für sich dem es auch als "
    "el los las y una por con para se del su lo como más no al si ha sus"
).split()
SYMBOLS = b"#*$%&|<>"
#: Classes of characters by their first byte: vowels, other a-z, A-Z, digits, white space, other ASCII, code points
#: 0x80-0x23F, all others.
CLASSES = 8
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123] = 1
_CLASS[[97, 101, 105, 111, 117]] = 0
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[0xC2:0xC9] = 6
_CLASS[0xC9:] = 7
_CLASS[0x80:0xC0] = -1  # continues a character
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _word_hashes() -> np.ndarray:
    (line,) = T.chunks(pa.array([" ".join(dict.fromkeys(COMMON_WORDS))]))
    return T.words(line, T.SPACED_WORDS).hash


_COMMON = _word_hashes()
_COMMON_ORDER = np.argsort(_COMMON)
BINS = CLASSES + len(_COMMON) + 1


def histograms(c: T.Chunk, w: T.Words | None = None) -> np.ndarray:
    """Rows x BINS: characters by class, then words by common word (ASCII letters in lower case), then other words."""
    w = w or T.words(c, T.SPACED_WORDS, T.ASCII_LOWER)
    kind = _CLASS[c.data]
    row = np.repeat(np.arange(c.rows), np.diff(c.offsets))
    first = kind >= 0
    chars = np.bincount(row[first] * CLASSES + kind[first], minlength=c.rows * CLASSES).reshape(c.rows, CLASSES)
    at = np.searchsorted(_COMMON, w.hash, sorter=_COMMON_ORDER)
    at[at == len(_COMMON)] = 0
    slot = _COMMON_ORDER[at]
    slot = np.where(_COMMON[slot] == w.hash, slot, len(_COMMON))
    n = len(_COMMON) + 1
    return np.hstack([chars, np.bincount(w.row * n + slot, minlength=c.rows * n).reshape(c.rows, n)])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of counts p to the counts q; 1 where either has none."""
    total, other = p.sum(axis=1, keepdims=True), q.sum()
    if not other:
        return np.ones(len(p))
    p, q = p / np.where(total == 0, 1, total), (q / other)[None, :]
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1)), 1.0)


def _span_hashes(c: T.Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(c.data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(T._BYTE[c.data] * T._power("up", T._MULT, n), out=total[1:])
    return T.mix((total[end] - total[start]) * T._power("down", T._INV, n + 1)[start] ^ (end - start).astype(np.uint64) * T._GRAM)


def base_counts(c: T.Chunk) -> dict[str, np.ndarray]:
    w = T.words(c, T.SPACED_WORDS)
    points = T.code_points(c)
    out = {"n_words": np.diff(w.bounds), "word_chars": np.bincount(w.row, points[w.end] - points[w.start], minlength=c.rows).astype(np.int64)}
    symbols = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(_SYMBOL[c.data], out=symbols[1:])
    out["n_symbols"] = np.diff(symbols[c.offsets])
    # Lines: those that have a word, less the different ones among them.
    breaks = np.flatnonzero(c.data == 10)
    start = np.unique(np.concatenate([c.offsets[:-1][np.diff(c.offsets) > 0], breaks + 1]))
    start = start[start < len(c.data)]
    end = np.append(start[1:], len(c.data)) if len(start) else start
    end = end - (c.data[end - 1] == 10) if len(start) else end
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[full], end[full]
    row = np.searchsorted(c.offsets, start, side="right") - 1
    key = T.mix(_span_hashes(c, start, end) + row.astype(np.uint64) * T._GRAM)
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=c.rows) - np.bincount(row[first], minlength=c.rows)
    # Windows of five words found twice or more in a row cover their words.
    at, h = T.grams(w, 5)
    key = T.mix(h + w.row[at].astype(np.uint64) * T._MULT)
    ordered = np.sort(key)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(w.hash) + 1, np.int64)
    if len(again):
        where = np.searchsorted(again, key)
        where[where == len(again)] = 0
        at = at[again[where] == key]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 5, -1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=c.rows)
    return out


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_words: int = 50) -> dict[str, np.ndarray]:
    """Summed histograms of all documents with a label and at least `min_words` words, for each label. The driver
    gets these sums only."""

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for c in T.chunks(batch.column(1), most_rows=4096):
                x = histograms(c)
                x = x * (x[:, CLASSES:].sum(axis=1) >= min_words)[:, None]
                names = batch.column(0).slice(c.first, c.rows).dictionary_encode()
                number = names.indices.to_numpy(zero_copy_only=False)
                for i, name in enumerate(names.dictionary.to_pylist()):
                    total[name] = total.get(name, 0) + x[number == i].sum(axis=0)
        rows = [(name, b, int(v)) for name, t in total.items() for b, v in enumerate(t) if v]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "bin", "n"])

    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    summed = rows.mapInArrow(sums, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    per = summed.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    out = {}
    for r in per.collect():
        out[r.lang] = np.zeros(BINS, np.int64)
        for b, n in r.bins.items():
            out[r.lang][b] = n
    return out


def judge_quality(
    docs: DataFrame,
    references: dict[str, np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 80,
    max_class_distance: float = 0.27,
    max_word_distance: float = 0.335,
) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    class_distance and word_distance to the reference where the larger of the two, each over its limit, is least.

    Null and empty texts have zeros, fail the base rules and are not kept. Texts of fewer than `min_words` words get no
    distances (null), nor do any if there is no reference; base rules alone decide then. Repeated rows are judged each.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    names = sorted(references)

    def judge(batches):
        for batch in batches:
            for c in T.chunks(batch.column(1), most_rows=4096):
                n = base_counts(c)
                failed = (n["n_words"] < 10) | (100 * n["n_repeat_words"] > 20 * n["n_words"])
                x = histograms(c)
                far = np.full((2, c.rows), np.nan)
                worst = np.full(c.rows, np.inf)
                for name in names:
                    a, b = js_distance(x[:, :CLASSES], references[name][:CLASSES]), js_distance(x[:, CLASSES:], references[name][CLASSES:])
                    ratio = np.maximum(a / max_class_distance, b / max_word_distance)
                    better = ratio < worst
                    worst = np.where(better, ratio, worst)
                    far[:, better] = np.stack([a, b])[:, better]
                judged = (n["n_words"] >= min_words) & bool(names)
                kept = ~failed & (~judged | (worst <= 1))
                cols = {k: pa.array(v, pa.int64()) for k, v in n.items()} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}
                cols |= {k: pa.array(v, pa.float64(), mask=~judged) for k, v in zip(("class_distance", "word_distance"), far, strict=True)}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.rows), *cols.values()], names=["_id", *cols])

    return source.mapInArrow(
        judge, f"_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    ).withColumnRenamed("_id", id_col)
