"""Vectorised handling of UTF-8 text columns in numpy, shared by the Python operators of this package.

A chunk of texts is one byte array with row offsets. Words are found by a table over byte values (every
separator used here is ASCII, so bytes of multi-byte characters never are separators) and hashed to 64 bits
without making Python strings. Hashes depend on the bytes alone: any executor gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd: it has an inverse modulo 2**64
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_GRAM = np.uint64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)

#: Words `[^\x20\x09-\x0D]+`.
SPACED_WORDS = np.ones(256, bool)
SPACED_WORDS[[32, 9, 10, 11, 12, 13]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and all beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[48:58] = ALNUM_WORDS[65:91] = ALNUM_WORDS[97:123] = ALNUM_WORDS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


@dataclass
class Chunk:
    """Texts `first` .. `first + rows` of a batch as bytes; row i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, most_rows: int = 1 << 16) -> Iterator[Chunk]:
    """Whole texts, in order, about `limit` bytes and `most_rows` rows at a time (one text that is longer comes alone).
    Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + most_rows)
        yield Chunk(at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    pa.default_memory_pool().release_unused()  # workers live on between tasks


@dataclass
class Words:
    """Words of a chunk in order: row of each, byte span, hash; word i of row r has bounds[r] <= i < bounds[r + 1]."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(chunk: Chunk, is_word: np.ndarray, fold: np.ndarray = AS_IS) -> Words:
    data, offsets, n = chunk.data, chunk.offsets, len(chunk.data)
    inside = is_word[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[(edges > 0) & (edges <= n)] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold[data]] * _power("up", _MULT, n), out=total[1:])
    h = (total[end] - total[start]) * _power("down", _INV, n + 1)[start]
    h = mix(h ^ ((end - start).astype(np.uint64) * _GRAM))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    return Words(row, start, end, h, bounds)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (as word numbers) and hashes of all runs of k words within one row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = h * _GRAM + w.hash[j : j + n]
    at = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return at, mix(h[at])


def run_hash(h: np.ndarray) -> int:
    """The hash that grams() gives to the run of exactly these word hashes."""
    acc = len(h)
    for x in h.tolist():
        acc = (acc * int(_GRAM) + x) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([acc], np.uint64))[0])


def code_points(chunk: Chunk) -> np.ndarray:
    """For each byte position and the end: code points before it in the whole chunk."""
    out = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=out[1:])
    return out
