"""Fill-in-middle examples, cut at line ends by rank and select over packed boundary bits.

The bytes of a chunk of texts have one bit each, set on the last byte of every unit (a line with its end, or what is left
after the last). Bits are packed into words, with a directory of the ones before each block of words. The ones of a text
are its units; the byte at which a prefix of k units ends is the select of the text's own rank plus k. So a cut costs two
look-ups, however long the text, and no list of lines is made.

Cost: one pass with no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T

_WORDS = 8  # words of 64 bits in a block of the directory

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


class Boundaries:
    """A bit vector with rank and select, for arrays of positions at a time."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(-(-max(len(bits), 1) // (64 * _WORDS)) * 8 * _WORDS, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view("<u8").reshape(-1, _WORDS)
        in_block = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(in_block)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, bit = np.divmod(at, 64 * _WORDS)
        words = np.vstack([self.words, np.zeros((1, _WORDS), np.uint64)])[block]  # a position may be the end
        left = np.clip(bit[:, None] - 64 * np.arange(_WORDS), 0, 64).astype(np.uint64)  # bits of each word that count
        mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, from 1."""
        block = np.searchsorted(self.before, k, side="left") - 1
        k = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        word = (upto < k[:, None]).sum(axis=1)
        every = np.arange(len(k))
        k = k - np.where(word > 0, upto[every, np.maximum(word, 1) - 1], 0)
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) < k[:, None]).sum(axis=1)
        return (block * _WORDS + word) * 64 + bit


def line_ends(chunk: T.Chunk) -> Boundaries:
    bits = chunk.data == 10
    filled = np.diff(chunk.offsets) > 0
    bits[chunk.offsets[1:][filled] - 1] = True
    return Boundaries(bits)


def _byte_cuts(chunk: T.Chunk, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes of the chunk at which first % (n + 1) and second % (n + 1) units end, in order."""
    ends = line_ends(chunk)
    ranks = ends.rank(chunk.offsets)
    n = np.diff(ranks)
    a, b = first % (n + 1), second % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = chunk.offsets[:-1].copy()
        some = np.flatnonzero(k)
        at[some] = ends.select(ranks[some] + k[some]) + 1
        cuts.append(at)
    return n, cuts[0], cuts[1]


def _check(sentinels: tuple[str, str, str]) -> None:
    for a in sentinels:
        for b in sentinels:
            if not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))) or sentinels.count(a) > 1:
                raise ValueError("sentinels must be distinct and must not overlap one another or themselves")


def fill_in_middle(
    docs: DataFrame, seed: int = 7, percent: int = 100, suffix_first: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n (lines), form, prefix_chars, middle_chars (code points), output (the example's text).

    Four numbers from a hash of seed and id choose: where prefix and middle end (after 0 to n lines), whether the text is
    rewritten at all (`percent` of them are), and whether the suffix comes first (`suffix_first` percent; form spm) or the
    prefix (psm). Texts that hold a sentinel, and empty ones, stay as they are (form plain, no counts). Null texts are
    empty, a null id hashes as an empty one, repeated rows give equal rows, other columns are ignored.
    """
    _check(sentinels)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_digest", digest).select("_id", "_text", *numbers)
    kind = source.schema["_id"].dataType.simpleString()
    P, S, M = (x.encode() for x in sentinels)

    def rewrite(batches):
        for batch in batches:
            h = [batch.column(2 + i).to_numpy() for i in range(4)]
            for c in T.chunks(batch.column(1)):
                mine = slice(c.first, c.first + c.rows)
                n, one, two = _byte_cuts(c, h[0][mine], h[1][mine])
                points = T.code_points(c)
                form, output = [], []
                for i in range(c.rows):
                    a, b, d, e = c.offsets[i], one[i], two[i], c.offsets[i + 1]
                    text = c.data[a:e].tobytes()
                    if not text or P in text or S in text or M in text or h[2][c.first + i] % 100 >= percent:
                        form.append("plain")
                        output.append(text)
                        continue
                    prefix, middle, suffix = text[: b - a], text[b - a : d - a], text[d - a :]
                    spm = h[3][c.first + i] % 100 < suffix_first
                    form.append("spm" if spm else "psm")
                    output.append(b"".join((S, suffix, P, prefix, M, middle) if spm else (P, prefix, S, suffix, M, middle)))
                plain = np.array([f == "plain" for f in form])
                counts = [pa.array(points[to] - points[start], pa.int64(), mask=plain) for start, to in ((c.offsets[:-1], one), (one, two))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.rows), pa.array(n, pa.int64()), pa.array(form), *counts, pa.array(output, pa.binary()).cast(pa.string())],
                    names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return source.mapInArrow(rewrite, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an example was made from."""
    P, S, M = sentinels

    def parts(first: str, second: str) -> Column:
        return F.split(F.substring(output, F.lit(len(first) + 1), F.length(output)), f"{re.escape(second)}|{re.escape(M)}", 3)

    psm, spm = parts(P, S), parts(S, P)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
