"""Dataset operators: mixing, sampling, apportioning, packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.strings import hash_fraction, tokens
from quillgraph.operators.ordered import fold_groups, running


def mix_weights(rows: DataFrame, group: str, size: str, target: dict[str, float]) -> DataFrame:
    """group, weight: target share over share of the sizes, scaled so that the mean over rows is 1."""
    share = F.lit(None).cast("double")
    for k, v in target.items():
        share = F.when(F.col(group) == k, v).otherwise(share)
    g = rows.groupBy(group).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    total = g.agg(F.sum("size").alias("total"))
    w = g.join(F.broadcast(total)).withColumn("w", share / (F.col("size") / F.col("total")))  # one row
    mean = w.agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"))
    return w.join(F.broadcast(mean)).select(group, (F.col("w") / F.col("mean")).alias("weight"))


def upsample(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Each row as often as its group falls short of the largest, at most `most` times; repeat_index from 0."""
    g = rows.groupBy(group).agg(F.count("*").alias("n"))
    k = g.join(F.broadcast(g.agg(F.max("n").alias("top")))).select(group, F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.col("top") / F.col("n")))).cast("int").alias("k"))
    return rows.join(k, group).withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")


def weighted_key(id_col: str, weight: Column) -> Column:
    """ln(u) / weight, u a hash of the id: rows are drawn from the largest on. It is divided as floating point has it: a
    weight of 0 gives less than any other (or NaN, more than any, should u be 1), and none gives null, which comes last."""
    u = F.log((F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 8), 16, 10).cast("double") + 1) / 4294967296.0)
    by_zero = F.when(u < 0, float("-inf")).when(u == 0, float("nan"))
    return F.when(weight == 0, by_zero).otherwise(u / weight)


def weighted_sample(rows: DataFrame, id_col: str, weight: Column, n: int) -> DataFrame:
    """n rows without replacement, by weight: the largest u ** (1 / weight), u a hash of the id. Rows of weight 0 come
    after all others, those without a weight last."""
    return rows.withColumn("_key", weighted_key(id_col, weight)).orderBy(F.desc_nulls_last("_key"), F.asc_nulls_last(id_col)).limit(n).drop("_key")


def split(rows: DataFrame, key: Column, parts: dict[str, float]) -> DataFrame:
    """part by a hash of the key: parts are shares that sum to 1, in order."""
    u, upto, out = hash_fraction(key), 0.0, F.lit(None).cast("string")
    edges = []
    for name, share in parts.items():
        upto += share
        edges.append((name, upto))
    for name, edge in reversed(edges):
        out = F.when(u < edge, name).otherwise(out)
    return rows.withColumn("part", F.coalesce(out, F.lit(edges[-1][0])))


def apportion(groups: DataFrame, group: str, n: str, seats: int) -> DataFrame:
    """group, seats by largest remainders (ties by name)."""
    q = groups.join(F.broadcast(groups.agg(F.sum(n).alias("total")))).select(group, (F.col(n) * float(seats) / F.col("total")).alias("share"))
    q = q.select(group, F.floor("share").alias("base"), (F.col("share") - F.floor("share")).alias("rest"))
    left = q.agg((F.lit(seats) - F.sum("base")).alias("left"))
    rn = F.row_number().over(Window.orderBy(F.desc("rest"), group))  # over groups, of which there are few
    return q.withColumn("rn", rn).join(F.broadcast(left)).select(group, (F.col("base") + (F.col("rn") <= F.col("left")).cast("int")).cast("long").alias("seats"))


def clamped_seats(groups: DataFrame, group: str, n: str, seats: int, floor: str, cap: str) -> DataFrame:
    """group, seats: in proportion to n, but none below its floor or above its cap (columns of whole numbers; a null cap
    is none), by largest remainders (ties by name). Floors that ask for more than the seats are given all the same, and
    caps that allow less leave seats over.

    Shares are rate * n within floor and cap, for the rate at which they sum to the seats. The sum bends where a group
    leaves its floor or reaches its cap: with these rates in order, running sums of slopes and constants give the piece
    in which the seats lie, and so the rate.
    """
    g = groups.select(F.col(group).alias("g"), F.col(n).cast("double").alias("n"), F.col(floor).cast("double").alias("lo"), F.coalesce(F.col(cap).cast("double"), F.lit(float("inf"))).alias("hi")).withColumn("hi", F.greatest("lo", "hi"))
    leaves = g.filter("n > 0").select((F.col("lo") / F.col("n")).alias("at"), F.col("n").alias("slope"), (-F.col("lo")).alias("const"))
    reaches = g.filter("n > 0 and hi < double('infinity')").select((F.col("hi") / F.col("n")).alias("at"), (-F.col("n")).alias("slope"), F.col("hi").alias("const"))
    bends = leaves.unionByName(reaches).groupBy("at").agg(F.sum("slope").alias("slope"), F.sum("const").alias("const"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # over groups, of which there are few
    floors = g.agg(F.sum("lo").alias("lo"))
    pieces = bends.withColumns({"slope": F.sum("slope").over(upto), "const": F.sum("const").over(upto), "next": F.lead("at").over(Window.orderBy("at"))}).join(F.broadcast(floors))  # one row
    rate = (F.lit(float(seats)) - F.col("lo") - F.col("const")) / F.col("slope")
    hit = pieces.filter(F.col("lo") + F.col("const") + F.col("slope") * F.col("at") <= seats + 1e-9).agg(F.max_by(F.when(F.col("slope") > 1e-12, rate).otherwise(F.col("at")), "at").alias("rate"))
    q = g.join(F.broadcast(hit)).withColumn("share", F.least("hi", F.greatest("lo", F.coalesce("rate", F.lit(0.0)) * F.col("n"))))  # one row
    q = q.withColumn("base", F.floor(F.col("share") + 1e-9)).withColumn("rest", F.round(F.col("share") - F.col("base"), 9))
    left = q.agg((F.lit(seats) - F.sum("base")).alias("left"))
    rn = F.row_number().over(Window.orderBy(F.desc("rest"), "g"))
    more = ((F.col("rn") <= F.col("left")) & (F.col("rest") > 0)).cast("long")
    return q.withColumn("rn", rn).join(F.broadcast(left)).select(F.col("g").alias(group), (F.col("base") + more).cast("long").alias("seats"))


def fair_share(items: DataFrame, group: str, budget: float) -> DataFrame:
    """group, id, given: max-min fair parts of the budget of a group, none above its size.

    With sizes ascending, the level is the first k with k-th size * (items left) beyond what remains: running sums, no
    loop.
    """
    x = running(items.select(group, "id", "size"), [group], [F.col("size"), F.col("id")], F.col("size"))
    level = (F.lit(budget) - F.col("before")) / (F.col("n") - F.col("place") + 1)
    x = x.select(group, "id", "size", level.alias("level"))
    cut = x.filter(F.col("size") > F.col("level")).groupBy(group).agg(F.min_by("level", F.struct("size", "id")).alias("cut"))
    return x.join(cut, group, "left").select(group, "id", F.least(F.col("size").cast("double"), F.coalesce("cut", F.col("size").cast("double"))).alias("given"))


def pack_consecutive(rows: DataFrame, group: str, order: str, size: Column, limit: int) -> DataFrame:
    """group, order, pack: neighbours share a pack while its size stays within the limit (a larger row is alone).

    The sum starts anew at each pack, which no window can say: a group's rows stream through a fold.
    """

    def pack(key, rows):
        number, used = 0, None
        for r in rows:
            n = r["_n"] or 0
            if used is not None and used + n > limit:
                number, used = number + 1, n
            else:
                used = (used or 0) + n
            yield (*key, r["_o"], number)

    kind = rows.schema[group].dataType.simpleString()
    sized = rows.select(group, F.col(order).cast("long").alias("_o"), size.cast("long").alias("_n"))
    return fold_groups(sized, [group], ["_o"], pack, f"{group} {kind}, {order} long, pack int")


def stratified_sample(rows: DataFrame, strata: str, id_col: str, seats: int, weight: Column | None = None, floor: int = 0, cap: int | None = None) -> DataFrame:
    """Seats by stratum size (largest remainders; none below the floor, as far as it has rows, or above the cap), filled
    by weighted hash order."""
    sizes = rows.groupBy(strata).agg(F.count("*").alias("n"))
    if floor or cap is not None:
        top = F.least(F.col("n"), F.lit(cap)) if cap is not None else F.col("n")
        by = clamped_seats(sizes.withColumns({"lo": F.least(F.lit(floor), top), "hi": top}), strata, "n", seats, "lo", "hi")
    else:
        by = apportion(sizes, strata, "n", seats)
    key = weighted_key(id_col, weight if weight is not None else F.lit(1))
    w = Window.partitionBy(strata).orderBy(F.desc("_key"), id_col)
    return rows.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).join(by, strata).filter("_rn <= seats").drop("_key", "_rn", "seats")



def balance(pairs: DataFrame, seed: str, band: float = 0.25, target: float = 0.0) -> DataFrame:
    """id, kind of the pairs that make a balanced set: every A; C pairs without those that a seeded order drops while the
    mean delta is above the band; then B pairs in a seeded order while the mean is below the target. ok: whether the
    mean lies within the band at the end.

    pairs: id, kind (A, B or C), delta. Each step is a running sum: the first place where the mean is reached.
    """
    key = F.sha2(F.concat(F.col("kind"), F.lit(f":{seed}:"), F.col("id").cast("string")), 256)
    sums = pairs.groupBy("kind").agg(F.sum("delta").alias("s"), F.count("*").alias("n")).collect()  # three rows at most
    s, n = ({r.kind: v for r, v in zip(sums, x, strict=True)} for x in ([r.s for r in sums], [r.n for r in sums]))
    # From the end of each order; before: what was dropped or added earlier.
    placed = running(pairs.filter("kind <> 'A'").select("id", "kind", "delta", F.translate(key, "0123456789abcdef", "fedcba9876543210").alias("k")), ["kind"], [F.col("k"), F.col("id")], F.col("delta"))
    all_s, all_n = s.get("A", 0) + s.get("C", 0), n.get("A", 0) + n.get("C", 0)
    c = placed.filter("kind = 'C'")
    left = F.lit(all_n) - F.col("place")
    done = c.filter((left == 0) | ((F.lit(all_s) - F.col("before") - F.col("delta")) / left <= band)).agg(F.min("place")).first()[0]
    drop = 0 if not all_n or all_s / all_n <= band else (done or n.get("C", 0))
    gone = c.filter(F.col("place") <= drop).agg(F.sum("delta")).first()[0] or 0
    now_s, now_n = all_s - gone, all_n - drop
    b = placed.filter("kind = 'B'")
    enough = b.filter((F.lit(now_s) + F.col("before") + F.col("delta")) / (F.lit(now_n) + F.col("place")) >= target).agg(F.min("place")).first()[0]
    add = 0 if (now_s / now_n if now_n else 0.0) >= target else (enough or n.get("B", 0))
    more = b.filter(F.col("place") <= add)
    end_s, end_n = now_s + (more.agg(F.sum("delta")).first()[0] or 0), now_n + add
    ok = not end_n or abs(end_s / end_n) <= band
    out = pairs.filter("kind = 'A'").select("id", "kind").unionByName(c.filter(F.col("place") > drop).select("id", "kind")).unionByName(more.select("id", "kind"))
    return out.withColumn("ok", F.lit(ok))


def lexical_overlap(items: DataFrame, docs: DataFrame, least: float, item_col: str = "item_id", doc_col: str = "doc_id", text_col: str = "text", block: int = 2_000) -> DataFrame:
    """item, doc, overlap: the share of an item's different words that a document has, from `least` on; items without
    words have none.

    One pass over the documents for each `block` of items, with no shuffle: an item's words go to the tasks as a sparse
    matrix of words by items, and a task counts what each document shares with each item as the product of the two.
    """
    distinct = F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    q = items.select(F.col(item_col).alias("i"), distinct.alias("w")).filter(F.size("w") > 0)
    d = docs.select(F.col(doc_col).alias("d"), distinct.alias("w"))
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((items, item_col), (docs, doc_col))]
    blocks = max(1, -(-q.count() // block))
    out = d.limit(0).select(F.lit(None).cast(kinds[0]).alias(item_col), F.col("d").alias(doc_col), F.lit(0.0).alias("overlap"))
    for b in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)).toArrow()
        if len(part):
            found = d.mapInArrow(_shared(part["i"].combine_chunks(), part["w"].combine_chunks(), least, [item_col, doc_col, "overlap"]), f"{item_col} {kinds[0]}, {doc_col} {kinds[1]}, overlap double")
            out = found if blocks == 1 else out.unionByName(found)
    return out


def _shared(ids: pa.Array, words: pa.Array, least: float, names: list[str], step: int = 500):
    """For a task: pairs of items and documents by the words that they share."""
    n = pc.list_value_length(words).to_numpy()
    coded = pc.dictionary_encode(words.flatten())
    at = np.asarray(coded.indices)
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(coded.dictionary) + 1))
    of = np.repeat(np.arange(len(n)), n)[order]  # items of each word, one word after another
    need = np.maximum(1, np.ceil(n * least - 1e-9))

    def count(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                mine = batch.slice(first, step)
                found = pc.index_in(mine.column(1).flatten(), value_set=coded.dictionary)
                row = np.repeat(np.arange(mine.num_rows), pc.list_value_length(mine.column(1)).to_numpy())[np.asarray(pc.is_valid(found))]
                word = found.drop_null().to_numpy()
                many = start[word + 1] - start[word]
                place = np.repeat(start[word] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many, many) + np.arange(many.sum())
                both = np.bincount(np.repeat(row, many) * len(n) + of[place], minlength=mine.num_rows * len(n)).reshape(-1, len(n))
                doc, item = np.nonzero(both >= need)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(item)), mine.column(0).take(pa.array(doc)), pa.array(both[doc, item] / n[item])], names=names)

    return count
