"""A signature tree over shingle sets, and its dual traversal: components of the sets that are similar enough.

Each set has a bitmap of its shingles. Leaves hold a few sets, nodes a few children; a node has the OR of the bitmaps,
the range of sizes and the largest excess (shingles less set bits) below it. Two sets below nodes X and Y share at most
c + excess shingles, with c the common bits, and no more than the smaller size: pairs of nodes that can't reach the
similarity are left out, and so are those below which everything is connected already. What remains of leaf pairs is
compared exactly, so that the components are exact.
"""

from __future__ import annotations

import numpy as np

_LEAF, _FAN = 8, 8


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], percent: int = 75):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.percent = percent
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        # Similar sets side by side: by size class, then least hash.
        self.order = np.lexsort((least, np.floor(np.log(np.maximum(self.n, 1)) / np.log(4 / 3)).astype(np.int64)))
        self.ids, self.tokens = None, flat
        self.starts = np.append(0, np.cumsum(self.n))
        self.parent = np.arange(len(sets))
        self.asks: list[np.ndarray] | None = None

    # Components so far.
    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self) -> np.ndarray:
        p = self.parent
        while (q := p[p]).tobytes() != p.tobytes():
            p = q
        self.parent = p.copy()
        return self.parent

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    # Exact comparison of one set with others.
    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.ids is None:  # numbers of the tokens, for lookups in a table
            values, ids = np.unique(self.tokens, return_inverse=True)
            self.ids, self.mark = ids.astype(np.int32), np.zeros(len(values), bool)
        mine = self.ids[self.starts[i] : self.starts[i + 1]]
        self.mark[mine] = True
        shared = np.zeros(len(others), np.int64)
        lengths = self.n[others]
        upto = np.append(0, np.cumsum(lengths))
        at = 0
        while at < len(others):  # some hundred thousand tokens at a time
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + 300_000, side="right")) - 1)
            first = upto[at:to] - upto[at]
            where = np.arange(upto[to] - upto[at]) + np.repeat(self.starts[others[at:to]] - first, lengths[at:to])
            shared[at:to] = np.add.reduceat(self.mark[self.ids[where]], first, dtype=np.int64)
            at = to
        self.mark[mine] = False
        return 100 * shared >= self.percent * (self.n[i] + lengths - shared)

    def _build(self) -> None:
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(float(np.median(self.n)), 1))), 8, 14))
        rank = np.empty(len(self.n), np.int64)
        rank[self.order] = np.arange(len(self.n))
        row = np.repeat(rank, self.n)
        word, bit = (self.tokens % np.uint64(bits)) // np.uint64(64), np.uint64(1) << (self.tokens % np.uint64(64))
        leaf = np.zeros((len(self.n), bits // 64), np.uint64)
        np.bitwise_or.at(leaf, (row, word.astype(np.int64)), bit)
        size = self.n[self.order]
        self.levels = [(leaf, size, size, size - np.bitwise_count(leaf).sum(axis=1).astype(np.int64))]
        for fan in [_LEAF] + [_FAN] * 20:
            bm, lo, hi, excess = self.levels[-1]
            if len(bm) == 1:
                break
            at = np.arange(0, len(bm), fan)
            self.levels.append((np.bitwise_or.reduceat(bm, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a similar pair that isn't connected yet."""
        bm, lo, hi, excess = self.levels[level]
        if self.asks is not None:
            some = self.asks[level][a] | self.asks[level][b]
            a, b, kept = a[some], b[some], some
        # With s the similarity, both sizes are within a factor of s, and share s / (1 + s) of their sum.
        ok = (100 * hi[a] >= self.percent * lo[b]) & (100 * hi[b] >= self.percent * lo[a])
        uniform = self.uniform[level]
        ok &= (uniform[a] < 0) | (uniform[a] != uniform[b])
        a, b = a[ok], b[ok]
        common, step = np.zeros(len(a), np.int64), max(1, (4 << 20) // (8 * bm.shape[1]))  # some megabytes at a time
        for at in range(0, len(a), step):
            common[at : at + step] = np.bitwise_count(bm[a[at : at + step]] & bm[b[at : at + step]]).sum(axis=1)
        most = np.minimum(common + np.minimum(excess[a], excess[b]), np.minimum(hi[a], hi[b]))
        ok[ok] = (100 + self.percent) * most >= self.percent * (lo[a] + lo[b])
        if self.asks is not None:
            kept[kept] = ok
            return kept
        return ok

    def _uniform(self) -> None:
        """For each node the component of all sets below it, or -1."""
        r = self.roots()[self.order]
        self.uniform = [r]
        for fan in [_LEAF] + [_FAN] * (len(self.levels) - 2):
            at = np.arange(0, len(r), fan)
            lo, hi = np.minimum.reduceat(r, at), np.maximum.reduceat(r, at)
            r = np.where((lo == hi) & (lo >= 0), lo, -1)
            self.uniform.append(r)

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fan, below = (_LEAF if level == 1 else _FAN), len(self.levels[level - 1][1])
        i, j = np.divmod(np.arange(fan * fan), fan)
        x, y = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
        ok = (x < below) & (y < below) & (x <= y if level > 1 else x < y)
        return x[ok], y[ok]

    def _asking(self, asking: np.ndarray) -> None:
        """For each node whether a set below it asks."""
        some = asking[self.order]
        self.asks = [some]
        for fan in [_LEAF] + [_FAN] * (len(self.levels) - 2):
            some = np.logical_or.reduceat(some, np.arange(0, len(some), fan))
            self.asks.append(some)

    def components(self, pivots: int = 2, labels: np.ndarray | None = None, asking: np.ndarray | None = None) -> np.ndarray:
        """For each set the number of the first set of its component. Sets of equal labels are connected to begin with;
        with `asking`, only pairs are compared of which one asks."""
        m = len(self.n)
        if labels is not None:
            _, first, back = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = first[back]
        if asking is not None:
            pivots = 0
        elif m == 2:
            if self.linked(0, np.array([1]))[0]:
                self.link(0, 1)
            return self.roots()
        # Some sets are compared with all others first: of a group of near copies that connects nearly everything.
        for k in range(min(pivots, m - 1)):
            i = int(self.order[(2 * k + 1) * m // (2 * pivots)])
            others = np.flatnonzero((self.roots() != self.roots()[i]) & (100 * self.n >= self.percent * self.n[i]) & (100 * self.n[i] >= self.percent * self.n))
            if len(others):
                for j in others[self.linked(i, others)].tolist():
                    self.link(i, j)
        if len(np.unique(self.roots())) == 1:
            return self.roots()
        self._build()
        self._uniform()
        if asking is not None:
            self._asking(asking)
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                self._compare(a, b)
                continue
            x, y = self._children(level, a, b)
            ok = self._possible(level - 1, x, y)
            x, y = x[ok], y[ok]
            for at in range(0, len(x), 2048):
                stack.append((level - 1, x[at : at + 2048], y[at : at + 2048]))
        return self.roots()

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        i, j = self.order[a], self.order[b]
        by = np.argsort(i, kind="stable")
        i, j = i[by], j[by]
        cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        joined = False
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            one, others = int(i[lo]), j[lo:hi]
            others = others[self.roots()[others] != self.find(one)] if joined else others[self.parent[others] != self.parent[one]]
            if len(others):
                for k in others[self.linked(one, others)].tolist():
                    self.link(one, k)
                    joined = True
        if joined:
            self._uniform()
