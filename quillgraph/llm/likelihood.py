"""Scores by masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Each word of a text is predicted from `side` words on both sides: embeddings of them, one hidden layer, and a softmax of
two levels over thousands of tokens, first their group, then the token within its group. A text's score is the sum of the
logarithms of these conditional probabilities. Tokens are the most frequent words of all documents, and buckets of the
other words by hash of their last bytes. Below a bucket each word has a leaf with its share of the bucket's words in the
corpus, so that the vocabulary grows with the distinct words. Leaves are the words found `least` times or more (the count
rises where they would be more than `most_leaves`); the words below that share the rest of their bucket evenly, a word
that was never seen counting as one more of them.

Texts are encoded once, as token numbers, and dealt by a hash of id and text to shards of about `SHARD_WORDS` words, in
the order of that hash. Training: the positions of a text fall into `rounds` parts by a hash of text and position. In a
round a copy of the network is trained on each shard, on the masked words of that part, by steps of gradient descent
with a rate for each parameter (by the sum of its squared gradients); then copies are averaged, each parameter by what its
squared gradients grew in each shard. So every word of every document is a target once, and the result depends on the
documents alone: not on partitions or tasks (but for the rounding of sums).

Cost: two passes over the texts, `rounds` + 1 over the encoded table (two bytes a word, which is shuffled once). Shuffled
besides: word counts, and for each shard and round a copy of the network (1.6 MB). Sent to the driver and each task:
the network, and to those that encode 12 bytes a leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import text as T
from quillgraph.session import cut

BATCH = 4096  # words of a step
SHARD_WORDS = 1 << 21
_PIECES = 16


@dataclass(frozen=True)
class Vocabulary:
    """Token numbers: 0 outside of the text, then frequent words, then buckets; leaves of the buckets, if any."""

    hashes: np.ndarray  # sorted
    numbers: np.ndarray
    buckets: int
    leaves: np.ndarray | None = None  # hashes, sorted
    shares: np.ndarray | None = None  # of each leaf: the logarithm of its probability within its bucket
    others: np.ndarray | None = None  # of each bucket: that of each word without a leaf
    words: int = 0  # of all documents

    @property
    def size(self) -> int:
        return 1 + len(self.hashes) + self.buckets

    @property
    def shards(self) -> int:
        return max(1, -(-self.words // SHARD_WORDS))

    def encode(self, c: T.Chunk, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: its token, and the logarithm of its probability within it (0 for frequent words)."""
        one, first, back = np.unique(w.hash, return_index=True, return_inverse=True)  # lookups for different words only
        bucket = bucket_of(c, w, first, self.buckets)
        tokens, within = 1 + len(self.hashes) + bucket, np.zeros(len(one))
        if self.others is not None:
            within = self.others[bucket]
        if self.leaves is not None and len(self.leaves):
            at, known = _lookup(self.leaves, one)
            within[known] = self.shares[at[known]]
        if len(self.hashes):
            at, known = _lookup(self.hashes, one)
            tokens[known], within[known] = self.numbers[at[known]], 0.0
        return tokens[back], within[back]


def _lookup(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == x


def bucket_of(c: T.Chunk, w: T.Words, at: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the words at `at` (ASCII letters in lower case)."""
    one, two = (T.ASCII_LOWER[c.data[np.maximum(w.end[at] - k, w.start[at])]].astype(np.uint64) for k in (1, 2))
    return (T.mix(one * np.uint64(131) + two) % np.uint64(buckets)).astype(np.int64)


def _scores(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = x @ weights
    z += bias
    return z


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of scores (which are overwritten), the sum of each row, and what was taken off its scores first. Scores are
    products with values of tanh, so that it is nothing but where exp would overflow."""
    most = 0.0
    if z.size and (top := float(z.max())) > 80:
        most = np.full(len(z), top - 80, z.dtype)
        z -= z.dtype.type(top - 80)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype), most


@dataclass
class Network:
    """embed: tokens x width; hidden: 2 * side * width x units (with bias); group: units x groups (with bias); word:
    groups x units x tokens of a group (with bias). Token t is the (t - 1) % k-th of group (t - 1) // k."""

    embed: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, tokens: int, side: int, width: int, units: int, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        wide, k = 2 * side * width, max(1, math.isqrt(max(tokens - 2, 0)) + 1)
        groups = max(1, -(-(tokens - 1) // k))

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        bias = np.zeros((groups, k), np.float32)
        bias.ravel()[tokens - 1 :] = -1e9  # no such tokens
        return cls(
            normal(tokens, width, scale=0.3), normal(wide, units, scale=wide**-0.5), np.zeros(units, np.float32),
            normal(units, groups, scale=0.1 * units**-0.5), np.zeros(groups, np.float32), normal(groups, units, k, scale=0.1 * units**-0.5), bias,
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.hidden_bias, self.group, self.group_bias, self.word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for a in self.arrays():
            parts.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return Network(*parts)

    def _by_group(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of rows by group, slots in that order, and each group's (number, from, to)."""
        k = self.word.shape[2]
        group = (target - 1) // k
        order = np.argsort(group, kind="stable")
        group = group[order]
        at = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
        return order, (target[order] - 1) % k, [(int(group[a]), a, b) for a, b in zip(at[:-1], at[1:], strict=True)]

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, batch: int = 16384) -> np.ndarray:
        out = np.zeros(len(target), np.float64)
        for first in range(0, len(target), batch):
            t = target[first : first + batch]
            order, slot, groups = self._by_group(t)
            x = np.take(self.embed, context[first : first + batch][order], axis=0).reshape(len(t), -1)
            h = np.tanh(_scores(x, self.hidden, self.hidden_bias))
            rows = np.arange(len(t))
            z = _scores(h, self.group, self.group_bias)
            found = z[rows, (t[order] - 1) // self.word.shape[2]].astype(np.float64)
            _, total, off = _exponentials(z)
            found -= np.log(total) + off
            for g, a, b in groups:
                z = _scores(h[a:b], self.word[g], self.word_bias[g])
                found[a:b] += z[rows[: b - a], slot[a:b]]
                _, total, off = _exponentials(z)
                found[a:b] -= np.log(total) + off
            out[first + order] = found
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray, out: Network | None = None) -> Network:
        """Of the mean of -log p, for each of the arrays (into those of `out`)."""
        out = out or self.like(np.empty_like(self.flat()))
        n = len(target)
        order, slot, groups = self._by_group(target)
        context, target = context[order], target[order]
        x = np.take(self.embed, context, axis=0).reshape(n, -1)
        h = _scores(x, self.hidden, self.hidden_bias)
        np.tanh(h, out=h)
        rows, scale = np.arange(n), h.dtype.type(1 / n)
        g, total, _ = _exponentials(_scores(h, self.group, self.group_bias))
        g *= (scale / total)[:, None]
        g[rows, (target - 1) // self.word.shape[2]] -= scale
        back = g @ self.group.T
        np.matmul(h.T, g, out=out.group)
        np.sum(g, axis=0, out=out.group_bias)
        out.word.fill(0)
        out.word_bias.fill(0)
        for j, a, b in groups:
            e, total, _ = _exponentials(_scores(h[a:b], self.word[j], self.word_bias[j]))
            e *= (scale / total)[:, None]
            e[rows[: b - a], slot[a:b]] -= scale
            back[a:b] += e @ self.word[j].T
            np.matmul(h[a:b].T, e, out=out.word[j])
            np.sum(e, axis=0, out=out.word_bias[j])
        np.square(h, out=h)
        np.subtract(1, h, out=h)
        back *= h
        np.matmul(x.T, back, out=out.hidden)
        np.sum(back, axis=0, out=out.hidden_bias)
        down = (back @ self.hidden.T).reshape(n * context.shape[1], -1)
        ids = context.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")  # a radix sort
        ids = ids[order]
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        out.embed.fill(0)
        out.embed[ids[at]] = np.add.reduceat(np.take(down, order, axis=0), at, axis=0)
        return out


class Descent:
    """A network in training: each parameter has a rate by the sum of its squared gradients so far. All parameters lie in
    one array, which the network's arrays are views of."""

    def __init__(self, network: Network, squares: np.ndarray, rate: float):
        self.flat, self.squares, self.rate, self.seen = network.flat(), squares.copy(), rate, 0
        self.network = network.like(self.flat)
        self.gradient, self.step_size = np.empty_like(self.flat), np.empty_like(self.flat)
        self.gradients = network.like(self.gradient)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        self.seen += len(target)
        self.network.gradients(context, target, self.gradients)
        g, size = self.gradient, self.step_size
        np.square(g, out=size)
        self.squares += size
        np.sqrt(self.squares, out=size)
        size += np.float32(1e-6)
        g *= np.float32(self.rate)
        g /= size
        self.flat -= g


def contexts(tokens: np.ndarray, bounds: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """For the words at `at`: the tokens of `side` words before and after them, 0 outside of the text. Row r has the words
    from bounds[r] to bounds[r + 1]."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(tokens)) + side * (row + 1)
    padded = np.zeros(len(tokens) + side * len(bounds), np.int64)
    padded[place] = tokens
    return padded[place[at][:, None] + np.array([*range(-side, 0), *range(1, side + 1)])]


def targets(seeds: np.ndarray, bounds: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The words that are masked in a round: those of its part, by hash of a row's seed and the position. Each word is
    masked in one round."""
    place = (np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    part = T.mix(np.repeat(seeds, np.diff(bounds)) + place * T._GRAM) >> np.uint64(32)
    return np.flatnonzero((part * np.uint64(rounds)) >> np.uint64(32) == turn)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text")).filter(F.length("text") > 0)


def build_vocabulary(docs: DataFrame, text_col: str = "text", frequent: int = 4032, buckets: int = 64, least: int = 2, most_leaves: int = 1 << 21) -> Vocabulary:
    """The most frequent words (ASCII letters in lower case) of all documents, ties by hash, and leaves for the rest."""

    def counts(batches):
        def rows(total):
            yield pa.RecordBatch.from_arrays([pa.array(total[0].view(np.int64)), pa.array(total[1], pa.int32()), pa.array(total[2], pa.int64())], names=["word", "bucket", "n"])

        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            words, bucket, n = (np.concatenate(x) for x in zip(empty, *held, strict=True))
            words, first, back = np.unique(words, return_index=True, return_inverse=True)
            return words, bucket[first], np.bincount(back, n, minlength=len(words)).astype(np.int64)

        for batch in batches:
            for c in T.chunks(batch.column(0)):
                w = T.words(c, T.SPACED_WORDS, T.ASCII_LOWER)
                one, at, times = np.unique(w.hash, return_index=True, return_counts=True)
                held.append((one, bucket_of(c, w, at, buckets), times))
                size += len(one)
                if size > 1_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                if size > 500_000:  # partial sums are enough
                    yield from rows(merged())
                    held, size = [], 0
        yield from rows(merged())

    summed = cut(_texts(docs, text_col).mapInArrow(counts, "word long, bucket int, n long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")))
    top = summed.orderBy(F.desc("n"), "word").limit(frequent).collect()
    hashes = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    found = Vocabulary(hashes[order], 1 + order.astype(np.int64), buckets)
    if not top:
        return found
    last = F.struct((-F.col("n")).alias("n"), "word") > F.struct(F.lit(-top[-1].n).cast("long").alias("n"), F.lit(top[-1].word).cast("long").alias("word"))
    rest = summed.filter(last)
    left = 0
    for r in sorted(rest.filter(F.col("n") >= least).groupBy("n").count().collect(), key=lambda r: -r.n):
        left += r["count"]
        if left > most_leaves:
            least = r.n + 1
            break
    total, low, kinds = np.ones(buckets), np.ones(buckets), np.ones(buckets)
    rare = F.col("n") < least
    for r in rest.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("low"), F.count_if(rare).alias("kinds")).collect():
        total[r.bucket] += r.n
        low[r.bucket] += r.low
        kinds[r.bucket] += r.kinds
    kept = rest.filter(~rare).toArrow()
    words = kept["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    shares = np.log(kept["n"].to_numpy() / total[kept["bucket"].to_numpy()]).astype(np.float32)
    every = sum(r.n for r in top) + int(total.sum()) - buckets
    return replace(found, leaves=words[order], shares=shares[order], others=np.log(low / total / kinds), words=every)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, shard, place (the hash by which a text has its place in the shard), tokens (two
    bytes each) and within (the logarithms of the words' probabilities within their tokens, summed); by shard and place.

    What is dealt by id and text can't meet in one shard as copies, but for repeated rows of one id."""
    place = F.xxhash64("_id", "_text")
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("place", place)
    kind = source.schema["_id"].dataType.simpleString()

    def tokens_of(batches):
        for batch in batches:
            for c in T.chunks(batch.column(1)):
                w = T.words(c, T.SPACED_WORDS, T.ASCII_LOWER)
                tokens, within = vocabulary.encode(c, w)
                tokens = tokens.astype(np.uint16)
                blobs = [tokens[a:b].tobytes() for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
                same = [batch.column(i).slice(c.first, c.rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(blobs, pa.binary()), pa.array(np.bincount(w.row, within, minlength=c.rows).astype(np.float64))], names=["id", "place", "tokens", "within"])

    shards = vocabulary.shards
    rows = source.mapInArrow(tokens_of, f"id {kind}, place long, tokens binary, within double").withColumn("shard", F.pmod("place", F.lit(shards)))
    tasks = min(shards, max(10_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.repartition(tasks, "shard").sortWithinPartitions("shard", "place")


def _rows_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch, and the bounds of its rows."""
    blobs = tokens.to_pylist()
    bounds = np.append(0, np.cumsum([len(b) // 2 for b in blobs])).astype(np.int64)
    return np.frombuffer(b"".join(blobs), np.uint16).astype(np.int64), bounds


def _average(parts: DataFrame) -> DataFrame:
    """Sums of pieces (piece, slot: copies, sums, weights), within what a task reads."""

    def summed(batches):
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                t = total.setdefault((r["piece"], r["slot"]), [0, 0.0, 0.0])
                t[0] += r["copies"]
                t[1] = t[1] + np.frombuffer(r["sums"], np.float64)
                t[2] = t[2] + np.frombuffer(r["weights"], np.float64)
        rows = [(piece, slot, n, s.tobytes(), w.tobytes()) for (piece, slot), (n, s, w) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PIECE_TYPES)], names=_PIECE_NAMES)

    return parts.mapInArrow(summed, _PIECE)


_PIECE = "piece int, slot int, copies long, sums binary, weights binary"
_PIECE_NAMES = ["piece", "slot", "copies", "sums", "weights"]
_PIECE_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def train(encoded: DataFrame, vocabulary: Vocabulary, rounds: int = 3, side: int = 2, width: int = 16, units: int = 32, rate: float = 0.15) -> Network:
    """encoded: as encode() gives it, written to storage as it is read in each round. No documents with words: the
    network as it starts."""
    network = Network.start(vocabulary.size, side, width, units)
    squares = np.full(network.flat().size, 1e-8, np.float32)
    slots = math.isqrt(vocabulary.shards - 1) + 1
    source = encoded.select("shard", "place", "tokens")
    for turn in range(rounds):

        def copies(batches, network=network, squares=squares, turn=turn):
            def pieces(shard: int, own: Descent) -> pa.RecordBatch:
                grown = own.squares.astype(np.float64) - squares
                cols = [np.array_split(x, _PIECES) for x in (own.flat * grown, grown)]
                rows = [(i, shard % slots, 1, s.tobytes(), w.tobytes()) for i, (s, w) in enumerate(zip(*cols, strict=True))]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PIECE_TYPES)], names=_PIECE_NAMES)

            at, own, near, goal = -1, None, np.zeros((0, 2 * side), np.int64), np.zeros(0, np.int64)
            for batch in batches:
                shards = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if shards[a] != at:
                        if len(goal):
                            own.step(near, goal)
                        if own is not None and own.seen:
                            yield pieces(at, own)
                        at, own, near, goal = int(shards[a]), Descent(network, squares, rate), near[:0], goal[:0]
                    tokens, bounds = _rows_of(batch.column(2).slice(a, b - a))
                    masked = targets(np.asarray(batch.column(1))[a:b].view(np.uint64), bounds, turn, rounds)
                    near, goal = np.concatenate([near, contexts(tokens, bounds, masked, side)]), np.concatenate([goal, tokens[masked]])
                    upto = len(goal) // BATCH * BATCH
                    for i in range(0, upto, BATCH):  # whole batches, whatever the rows that came at once
                        own.step(near[i : i + BATCH], goal[i : i + BATCH])
                    near, goal = near[upto:], goal[upto:]
            if len(goal):
                own.step(near, goal)
            if own is not None and own.seen:
                yield pieces(at, own)

        first = _average(source.mapInArrow(copies, _PIECE).repartition("piece", "slot"))
        last = _average(first.withColumn("slot", F.lit(0)).repartition("piece")).collect()  # _PIECES rows
        if last:
            rows = sorted(last, key=lambda r: r.piece)
            sums, weights = (np.concatenate([np.frombuffer(bytes(r[c]), np.float64) for r in rows]) for c in ("sums", "weights"))
            moved = weights > 0
            network = network.like(np.where(moved, sums / np.where(moved, weights, 1), network.flat()).astype(np.float32))
            squares = (squares + weights / rows[0].copies).astype(np.float32)
    return network


def score_encoded(encoded: DataFrame, network: Network, id_col: str = "doc_id", side: int = 2) -> DataFrame:
    """Of each encoded row: id, n_words, log_likelihood (sum over all words) and per_word (its mean; null without words)."""

    def score(batches):
        for batch in batches:
            tokens, bounds = _rows_of(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            total = np.asarray(batch.column(2)).astype(np.float64)
            near = contexts(tokens, bounds, np.arange(len(tokens)), side)
            total = total + np.bincount(row, network.log_probabilities(near, tokens), minlength=batch.num_rows)
            n = np.diff(bounds)
            mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total), mean], names=["id", "n_words", "log_likelihood", "per_word"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "tokens", "within").mapInArrow(score, f"id {kind}, n_words long, log_likelihood double, per_word double").withColumnRenamed("id", id_col)


def score_pseudo_likelihood(docs: DataFrame, vocabulary: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text", side: int = 2) -> DataFrame:
    """One row per row of docs: id, n_words, log_likelihood and per_word, as score_encoded() gives them.

    Null and empty texts have no words and 0. Repeated rows are scored each; other columns are ignored.
    """
    return score_encoded(encode(docs, vocabulary, id_col, text_col), network, id_col, side)
