"""Exact Jaccard join of documents on word shingles by signature trees, giving components of linked documents.

1. Classes. Each text becomes its set of shingle hashes; texts with equal sets (128-bit digest) are one class.
2. Candidates. Sets are ordered by hash. Two sets that link share at least min(l, l') of their first
   p(n) = n - ceil(s n) + l(n) hashes, with l(n) about n / 8. So only those tokens are dealt out, in blocks of bytes, to
   buckets, whose number follows the bytes; a token that two classes have names the least class as its hub. A token that
   very many classes have (by a sample of the classes) is a hub itself, so that they need not meet in a bucket: which
   tokens these are changes no result. A class with fewer shared tokens than any link needs is alone. Others drop
   their weakest hubs as long as these hold less than half of what a link needs: linked classes keep a hub in common,
   while a passage that many documents share ties none of them together.
3. Groups. Connected components over kept hubs hold every linked pair. A group that is too large for a task is mostly
   tied by chance: its classes become candidates once more, among each other, with l(n) about n / 2 (twice the tokens, of
   these classes only). A link then needs four times as many tokens in common, and that many more weak hubs drop. Sets of
   groups are read again, by a bitmap of ids.
4. Trees. A group is searched by a signature tree (signature_tree.py), which compares the remaining pairs exactly. A
   group that is still too large for a task is dealt out in blocks by a hash, with some sets that are in all blocks. Whatever
   isn't in its group's largest component after that is compared with all blocks, by trees too and in bounded tasks.

No pair list is built, exact copies never meet as pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm import text as T
from quillgraph.llm.components import components_of_members, connected_components
from quillgraph.llm.signature_tree import SignatureTree
from quillgraph.session import arrow_rows, cut

_TOKEN_BITS = 48
_BUCKET_BYTES = 8 << 20  # of tokens that meet
_SAMPLED = 64  # of so many classes one is looked at for common tokens
_MANY = 32  # classes of the sample that make a token common
_MOST_COMMON = 1 << 20
_PART, _LARGE_PART = 8, 2  # l(n) is n by this: at first, and within large groups
_SET_ROWS = 256  # sets that a task sends to Python at once: some kilobytes each
_TEXT_ROWS = 1024  # texts


class Shingles:
    """The distinct shingle hashes of each text of a chunk, by row, then hash. A text of fewer words than a shingle has
    is one shingle; one without words has none."""

    def __init__(self, c: T.Chunk, k: int):
        w = T.words(c, T.SPACED_WORDS, T.ASCII_LOWER)
        at, h = T.grams(w, k)
        row = w.row[at]
        n = np.diff(w.bounds)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            whole = np.array([T.run_hash(w.hash[w.bounds[r] : w.bounds[r + 1]]) for r in short.tolist()], np.uint64)
            row, h = np.concatenate([row, short]), np.concatenate([h, whole])
        bits = max(int(c.rows - 1).bit_length(), 1)
        order = np.argsort((row.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        self.row, self.hash = row[new], h[new]
        self.bounds = np.searchsorted(self.row, np.arange(c.rows + 1))
        self.n = np.diff(self.bounds)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of each set; the second is even, so that there is room for hubs among odd numbers."""
        out = []
        for salt in (T._MULT, T._GRAM):
            total = np.append(np.zeros(1, np.uint64), np.cumsum(T.mix(self.hash ^ salt)))
            out.append(T.mix(total[self.bounds[1:]] - total[self.bounds[:-1]]))
        return out[0].view(np.int64), (out[1] & ~np.uint64(1)).view(np.int64)


def _least_shared(n, part: int):
    """l(n): how many of the first tokens two linked sets of this size share at least. It may be any number up to
    ceil(s n)."""
    return np.maximum(n // part, 1)


def _first_percent(percent: int, part: int) -> int:
    """p(n) of n, about."""
    return 100 - percent - (-100 // part)


def _ceil_part(n, percent: int):
    return -(-n * percent // 100)


def _first_tokens(s: Shingles, percent: int, part: int) -> np.ndarray:
    """Which hashes are among the p(n) first of their set."""
    return np.arange(len(s.hash)) - s.bounds[s.row] < (s.n - _ceil_part(s.n, percent) + _least_shared(s.n, part))[s.row]


@dataclass
class _Ids:
    """A set of ids as a bitmap of their hashes, which by chance has some more."""

    bits: int
    words: np.ndarray

    def place(self) -> Column:
        return _place(self.bits)

    def chosen(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of batches whose last column, place(), is in the bitmap."""
        for batch in batches:
            p = np.asarray(batch.column(batch.num_columns - 1)).astype(np.int64)
            some = np.flatnonzero(self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1))
            if len(some):
                yield batch.take(pa.array(some))


def _place(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)


def _ids(ids: DataFrame, count: int) -> _Ids:
    """The ids in `ids`, of which there are `count`. Beyond some ten million ids the bitmap is fuller and more texts are
    read than needed; it is 8 MB at most."""
    bits = min(26, max(20, (8 * count).bit_length()))
    found = ids.select(_place(bits).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    words = np.zeros(1 << (bits - 6), np.uint64)
    got = found.toArrow()  # a row for each 64 bits at most, whatever the number of ids
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return _Ids(bits, words)


def _read(docs: DataFrame, columns: list, only: _Ids | None, read: Callable, schema: str) -> DataFrame:
    """`read` of the columns of docs, of those in `only` if it is given. They are chosen by the worker that reads them:
    operators in Python, one behind the other, would take a worker each in every task."""
    if only is None:
        return docs.select(*columns).mapInArrow(read, schema)
    return docs.select(*columns, only.place().alias("place")).mapInArrow(lambda batches: read(only.chosen(batches)), schema)


def _documents(docs: DataFrame, k: int, percent: int, part: int, only: _Ids | None = None) -> DataFrame:
    """id, text_hash, size and digests of each text; of each 64th class, by its key, also the first tokens."""

    def digest(batches):
        for batch in batches:
            for c in T.chunks(batch.column(1)):
                s = Shingles(c, k)
                hi, key = s.digests()
                tokens = s.hash >> np.uint64(64 - _TOKEN_BITS)
                first = _first_tokens(s, percent, part)
                asked = ((key >> 1) % _SAMPLED == 0) & (s.n > 0)
                sample = [tokens[s.bounds[r] : s.bounds[r + 1]][first[s.bounds[r] : s.bounds[r + 1]]].tobytes() if asked[r] else None for r in range(c.rows)]
                same = [batch.column(i).slice(c.first, c.rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(s.n, pa.int64()), pa.array(hi), pa.array(key), pa.array(sample, pa.binary())], names=["id", "text_hash", "n", "hi", "key", "sample"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, n long, hi long, key long, sample binary"
    return _read(docs, ["id", "text", F.xxhash64("text")], only, digest, schema)


def _common_tokens(rows: DataFrame, shingles: int, first_percent: int) -> np.ndarray:
    """Tokens that very many classes have among their first, sorted: those of `_MANY` classes or more of the sample (of
    more where these could be over `_MOST_COMMON`: what comes to the driver is never more)."""

    def unpack(batches):
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    least = max(_MANY, -(-shingles * first_percent // (100 * _SAMPLED * _MOST_COMMON)))
    sampled = rows.filter("sample is not null").groupBy("hi", "key").agg(F.first("sample").alias("sample")).select("sample")
    common = sampled.mapInArrow(unpack, "token long").groupBy("token").count().filter(F.col("count") >= least)
    return np.sort(common.select("token").toArrow()["token"].to_numpy().view(np.uint64))


def _token_blocks(docs: DataFrame, k: int, percent: int, part: int, buckets: int, common: np.ndarray, only: _Ids | None, flush: int = 500_000) -> DataFrame:
    """bucket, tokens (32 bits beyond those of the bucket) and keys, as bytes. Tokens that very many classes have lie in
    buckets below 0 by key, and are numbers in `common`."""
    shift = np.uint64(64 - _TOKEN_BITS)

    def deal(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks():
            tokens, keys = np.concatenate([t for t, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            rest = (tokens // np.uint64(buckets)).astype(np.uint32)
            if len(common):
                at = np.searchsorted(common, tokens)
                at[at == len(common)] = 0
                many = common[at] == tokens
                bucket[many], rest[many] = -1 - (keys[many] >> 1) % buckets, at[many]
            order = np.argsort(bucket, kind="stable")
            at = np.append(np.flatnonzero(np.diff(bucket[order], prepend=buckets)), len(order))
            rest, keys = rest[order], keys[order]
            rows = [(int(bucket[order[a]]), rest[a:b].tobytes(), keys[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "tokens", "keys"])

        for batch in batches:
            for c in T.chunks(batch.column(0)):
                s = Shingles(c, k)
                once = np.zeros(c.rows, bool)  # copies within a chunk go once
                once[np.unique(s.digests()[1], return_index=True)[1]] = True
                first = _first_tokens(s, percent, part) & once[s.row]
                if first.any():
                    held.append((s.hash[first] >> shift, s.digests()[1][s.row[first]]))
                if sum(len(t) for t, _ in held) > flush:
                    yield blocks()
        if held:
            yield blocks()

    return _read(docs, ["text"], only, deal, "bucket int, tokens binary, keys binary")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows of a sorted stream, one table for each value of the columns in `by`."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in by]
        change = np.zeros(batch.num_rows, bool)
        for x in codes:
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(x[a] for x in codes)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _hubs(blocks: DataFrame, tasks: int, common: np.ndarray) -> DataFrame:
    """key, hub, shared: tokens that a class shares with others and whose least class is the hub. A token that very many
    classes have is a hub itself (an odd number), so that its classes need not meet."""

    def meet(batches):
        for g in _groups(batches, ["bucket"]):
            tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in g.column("tokens").to_pylist()])
            keys = np.concatenate([np.frombuffer(x, np.int64) for x in g.column("keys").to_pylist()])
            order = np.lexsort((keys, tokens))
            tokens, keys = tokens[order], keys[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
            tokens, keys = tokens[new], keys[new]
            if g.column("bucket")[0].as_py() < 0:
                hub, many = (T.mix(common[tokens]) | np.uint64(1)).view(np.int64), np.ones(len(keys), np.int64)
            else:
                at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
                many = np.diff(np.append(at, len(tokens)))
                shared, hub = np.repeat(many > 1, many), np.repeat(keys[at], many)
                keys, hub = keys[shared], hub[shared]
                order = np.lexsort((hub, keys))
                keys, hub = keys[order], hub[order]
                at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (hub[1:] != hub[:-1]))) if len(keys) else np.zeros(0, np.int64)
                keys, hub, many = keys[at], hub[at], np.diff(np.append(at, len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(hub), pa.array(many, pa.int64())], names=["key", "hub", "n"])

    dealt = blocks.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket")  # a bucket a task
    return dealt.mapInArrow(meet, "key long, hub long, n long").groupBy("key", "hub").agg(F.sum("n").alias("shared"))


def _sets(docs: DataFrame, k: int, ids: DataFrame, count: int) -> DataFrame:
    """hi, key and set of the documents that are chosen by `ids`."""

    def read(batches):
        for batch in batches:
            for c in T.chunks(batch.column(0)):
                s = Shingles(c, k)
                hi, key = s.digests()
                rows = np.flatnonzero(s.n > 0)
                blobs = [s.hash[s.bounds[r] : s.bounds[r + 1]].tobytes() for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(hi[rows]), pa.array(key[rows]), pa.array(blobs, pa.binary())], names=["hi", "key", "tokens"])

    return _read(docs, ["text"], _ids(ids, count), read, "hi long, key long, tokens binary")


def _classes_of(g: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first row of each class of a group, in order, and its set."""
    pair = np.stack([g.column("hi").to_numpy(), g.column("key").to_numpy()])
    one = np.sort(np.unique(pair, axis=1, return_index=True)[1])
    return one, [np.frombuffer(x, np.uint64) for x in g.column("tokens").take(pa.array(one)).to_pylist()]


def _search(rows: DataFrame, percent: int, id_type: str) -> DataFrame:
    """For each class of a block: big (whether its group has other blocks), and of the first class that it is connected
    with there the key and the first document. Rows are ordered by first document, so that this is the least one."""

    def search(batches):
        for g in _groups(batches, ["group", "block"]):
            one, sets = _classes_of(g)
            root = SignatureTree(sets, percent).components() if len(sets) > 1 else np.zeros(len(sets), np.int64)
            of = pa.array(one[root])
            own = [g.column(c).take(pa.array(one)).combine_chunks() for c in ("big", "hi", "key")]
            yield pa.RecordBatch.from_arrays([*own, *[g.column(c).take(of).combine_chunks() for c in ("key", "none", "id", "text_hash")]], names=["big", "hi", "key", "root", "none", "id", "text_hash"])

    dealt = rows.repartition("group", "block").sortWithinPartitions("group", "block", "none", "id", "text_hash")
    return dealt.mapInArrow(search, f"big boolean, hi long, key long, root long, none boolean, id {id_type}, text_hash long")


def _search_rest(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of labels (u, v) that a set which is `asking` connects, by a tree over all sets of a block."""

    def search(batches):
        for g in _groups(batches, ["group", "block", "turn"]):
            one, sets = _classes_of(g)
            label, asking = (g.column(c).to_numpy(zero_copy_only=False)[one] for c in ("label", "asking"))
            if len(sets) > 1 and asking.any():
                root = label[SignatureTree(sets, percent).components(labels=label, asking=asking)]
                pairs = np.unique(np.stack([label, root])[:, label != root], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return rows.repartition("group", "block", "turn").sortWithinPartitions("group", "block", "turn").mapInArrow(search, "u long, v long")


def _grouped(docs: DataFrame, k: int, percent: int, part: int, classes: DataFrame, shingles: int, common: np.ndarray, only: _Ids | None = None) -> DataFrame:
    """key, group of the classes that may link with others: what a class shares with them, its weakest hubs left out."""
    buckets = max(1, -(-shingles * 12 * _first_percent(percent, part) // (100 * _BUCKET_BYTES)))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * buckets)
    hubs = _hubs(_token_blocks(docs, k, percent, part, buckets, common, only), tasks, common).join(classes.groupBy("key").agg(F.max("n").alias("size")), "key")
    # Of the sizes of its partners, the least decides: l(ceil(s n)).
    needed = F.greatest(F.floor(F.ceil(F.col("size") * percent / 100 - 1e-9) / part), F.lit(1))
    weakest = Window.partitionBy("key").orderBy("shared", "hub")
    hubs = hubs.select("key", "hub", needed.alias("needed"), F.sum("shared").over(Window.partitionBy("key")).alias("all"), F.sum("shared").over(weakest.rowsBetween(Window.unboundedPreceding, 0)).alias("sofar"))
    kept = hubs.filter("all >= needed and sofar > floor((needed - 1) / 2)")
    return components_of_members(kept.select(F.col("key").alias("member"), "hub")).select(F.col("member").alias("key"), F.col("label").alias("group"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, block_tokens: int = 600_000, block_sets: int = 4096
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that it reaches over links, its own
    included; links are pairs of texts with 100 * shared >= percent * all shingles), text_hash (xxhash64 of the text), and
    first: whether it has the smallest id, then text_hash, of its component.

    Null, empty and blank texts have no shingles and link with nothing: their component is their own id, and they
    are first. Repeated rows and ids each keep a row; rows with the same id and text are first together. Rows without an id take part; their component is the smallest id reached, or null. Other
    columns are ignored and may have any names.
    """
    with arrow_rows(docs.sparkSession, _TEXT_ROWS):  # what is returned runs no Python
        return _near_duplicates(docs, id_col, text_col, shingle, percent, block_tokens, block_sets)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, block_tokens: int, block_sets: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    rows = cut(_documents(docs, shingle, percent, _PART))
    total = rows.agg(F.sum("n")).first()[0] or 0
    common = _common_tokens(rows, total, _first_percent(percent, _PART))
    rows = rows.select("n", "hi", "key", F.struct(F.col("id").isNull().alias("none"), "id", "text_hash").alias("me"))
    classes = cut(rows.filter("n > 0").groupBy("hi", "key").agg(F.min("n").alias("n"), F.min("me").alias("first")))

    def measured(members: DataFrame) -> DataFrame:
        blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("sets") / block_sets)).cast("int")
        pivots = [F.min(F.when(_part("key") == i, F.xxhash64("key", F.lit(3)))).alias(f"p{i}") for i in range(4)]
        sizes = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), *pivots)
        return cut(sizes.filter("sets > 1").select("group", blocks.alias("blocks"), *[f"p{i}" for i in range(4)]))

    members = cut(classes.join(_grouped(docs, shingle, percent, _PART, classes, total, common), "key"))
    sizes = measured(members)
    wide = sizes.filter("blocks > 1").select("group")
    if percent >= 50 and not wide.isEmpty():  # l(n) is ceil(s n) at most
        large = cut(members.join(wide, "group", "left_semi").drop("group"))
        seen = large.agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).first()
        some = _ids(large.select("first.id"), seen.sets)
        common = _common_tokens(_documents(docs, shingle, percent, _LARGE_PART, some), seen.tokens, _first_percent(percent, _LARGE_PART))
        again = large.join(_grouped(docs, shingle, percent, _LARGE_PART, large, seen.tokens, common, some), "key")
        members = cut(members.join(wide, "group", "left_anti").unionByName(again))
        sizes = measured(members)
    pivot = F.xxhash64("key", F.lit(3)).isin(*[F.col(f"p{i}") for i in range(4)])
    members = cut(members.join(sizes, "group").select("group", "blocks", "hi", "key", "n", "first", pivot.alias("pivot")))
    count = members.count()

    # Trees over groups; those of several blocks have some sets (pivots) in all of them.
    home = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    places = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    sets = _sets(docs, shingle, members.select("first.id"), count).join(members.select("group", "blocks", "hi", "key", places.alias("places"), "first.*"), ["hi", "key"])
    sets = sets.select("group", F.explode("places").alias("block"), (F.col("blocks") > 1).alias("big"), "hi", "key", "none", "id", "text_hash", "tokens")
    with arrow_rows(spark, _SET_ROWS):
        edges = cut(_search(sets, percent, id_type))
    component = F.struct("none", "id", "text_hash").alias("component")
    labelled = edges.filter("not big").select("hi", "key", component)
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        labels = cut(components_of_members(edges.filter("big").select(F.col("key").alias("member"), F.col("root").alias("hub")))).withColumnRenamed("member", "key")
        labels = _across_blocks(docs, shingle, large, labels, percent, block_tokens, block_sets, home)
        whole = cut(large.select("hi", "key", "first").join(labels, "key"))
        least = cut(whole.groupBy("label").agg(F.min("first").alias("component")))
        labelled = labelled.unionByName(whole.join(least, "label").select("hi", "key", "component"))
    by_class = cut(classes.join(labelled, ["hi", "key"], "left").select("hi", "key", F.coalesce("component", "first").alias("component")))
    found = rows.filter("n > 0").join(by_class, ["hi", "key"]).select("me", "n", "component")
    found = found.unionByName(rows.filter("n = 0").select("me", "n", F.col("me").alias("component")))
    return found.select(
        F.col("me.id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"), "me.text_hash", F.col("me").eqNullSafe(F.col("component")).alias("first")
    )


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(4))


def _across_blocks(docs: DataFrame, k: int, large: DataFrame, labels: DataFrame, percent: int, block_tokens: int, block_sets: int, home: Column) -> DataFrame:
    """key, label of the members of groups of several blocks. labels: what their blocks linked. The sets outside of a
    group's largest component so far are compared with all others of the group; mostly there are none."""
    tagged = cut(large.join(labels, "key"))
    main = cut(tagged.groupBy("group", "label").agg(F.count("*").alias("many")).groupBy("group").agg(F.max_by("label", F.struct("many", "label")).alias("main")))
    tagged = cut(tagged.join(main, "group").select("group", "blocks", "hi", "key", "n", "first", "label", (F.col("label") != F.col("main")).alias("asking")))
    if tagged.filter("asking").isEmpty():
        return labels
    turns = cut(tagged.filter("asking").groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / block_tokens), F.ceil(F.count("*") / block_sets)).cast("int").alias("turns")))
    tagged = cut(tagged.join(turns, "group"))
    turn = F.pmod(F.xxhash64("key", F.lit(4)), F.col("turns")).cast("int")
    # Members in their block at every turn; those that ask in every block, at their turn (and not as members there).
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    asks = F.when(F.col("asking"), every("blocks", lambda b: F.struct(b.alias("block"), turn.alias("turn"), F.lit(True).alias("asking"))))
    is_at = every("turns", lambda t: F.struct(home.alias("block"), t.alias("turn"), F.lit(False).alias("asking")))
    others = F.filter(is_at, lambda p: ~F.col("asking") | (p["turn"] != turn))
    places = tagged.select("group", "hi", "key", "label", F.concat(F.coalesce(asks, F.array().cast("array<struct<block:int,turn:int,asking:boolean>>")), others).alias("places"))
    sets = _sets(docs, k, tagged.select("first.id"), tagged.count()).join(places, ["hi", "key"])
    rows = sets.select("group", "hi", "key", "label", "tokens", F.explode("places").alias("p")).select("group", "hi", "key", "label", "tokens", "p.*")
    with arrow_rows(docs.sparkSession, _SET_ROWS):
        more = cut(_search_rest(rows, percent))
    further = cut(connected_components(more)).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return labels.join(further, "label", "left").select("key", F.coalesce("least", "label").alias("label"))
