"""Texts cut into chunks: sections of markdown, packed blocks; and nested tables of contents.

A text becomes a row for each line. Lines are classified by what they and their neighbours are; running counts along a
text number its sections and blocks, and the last heading of each level that is still open gives a section's path. Blocks
are put together again by grouping, and packed by folds over the arrays of a text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
_JOINT = "\n\n"


def _fenced(lines: Column) -> Column:
    """A digit for each line: 1 opens a fence, 2 is within one or closes it, 0 is outside. A fence is closed by its kind."""
    mark = lambda x: F.when(F.trim(x).startswith("```"), "`").when(F.trim(x).startswith("~~~"), "~").otherwise("")

    def step(s: Column, x: Column) -> Column:
        m = mark(x)
        digit = F.when(s["open"] != "", "2").when(m != "", "1").otherwise("0")
        after = F.when(s["open"] == "", m).when(m == s["open"], "").otherwise(s["open"])
        return F.struct(after.alias("open"), F.concat(s["out"], digit).alias("out"))

    return F.aggregate(lines, F.struct(F.lit("").alias("open"), F.lit("").alias("out")), step, lambda s: s["out"])


def lines_of(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """_row, i, line, kind (heading, rule, blank, table, text), level, title, fence; and the columns to keep."""
    split = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    one = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), split.alias("_lines")).withColumn("_fence", _fenced(F.col("_lines")))
    each = one.select(*keep, "_row", "_fence", F.posexplode("_lines").alias("i", "line"))
    each = each.select(*keep, "_row", "i", "line", F.expr("substring(_fence, i + 1, 1)").alias("fence"))
    bare, plain = F.trim(F.col("line")), F.col("fence") == "0"
    atx = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"(^|\s)#*\s*$", ""))
    first = F.when(~plain, "text").when(bare == "", "blank").when((atx != "") & (title != ""), "heading").when(bare.startswith("|"), "table").otherwise("text")
    each = each.select("*", first.alias("kind"), F.length(atx).alias("level"), title.alias("title"))
    # A line of text over a rule is a heading, and the rule goes.
    w = Window.partitionBy("_row").orderBy("i")
    under = F.when(plain & F.col("line").rlike(r"^\s{0,3}=+\s*$"), 1).when(plain & F.col("line").rlike(r"^\s{0,3}--+\s*$"), 2)
    each = each.withColumn("_under", under)
    lined = (F.col("kind") == "text") & plain
    over = F.lag(lined & F.col("_under").isNull()).over(w) & F.col("_under").isNotNull()
    below = F.lead("_under").over(w)
    headed = lined & F.col("_under").isNull() & below.isNotNull()
    kind = F.when(over, "rule").when(headed, "heading").otherwise(F.col("kind"))
    return each.select(*keep, "_row", "i", "line", "fence", kind.alias("kind"), F.when(headed, below).otherwise(F.col("level")).alias("level"), F.when(headed, bare).otherwise(F.col("title")).alias("title"))


def blocks_of(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """_row, section, block, path (of the section's headings), text, is_table; and the columns to keep. Blocks end at blank
    lines, headings, where tables begin or end, and before fences; within a fence nothing ends."""
    w = Window.partitionBy("_row").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = lines_of(docs, text, *keep)
    x = x.withColumn("_body", F.col("kind").isin("text", "table"))
    before, tabled = F.lag("kind").over(w), F.col("kind") == "table"
    starts = F.col("_body") & (before.isNull() | ~before.isin("text", "table") | ((before == "table") != tabled) | (F.col("fence") == "1"))
    x = x.select("*", F.sum((F.col("kind") == "heading").cast("int")).over(upto).alias("section"), F.sum(starts.cast("int")).over(upto).alias("block"))
    opened = [F.last(F.when((F.col("kind") == "heading") & (F.col("level") == n), F.struct("i", "title")), ignorenulls=True).over(upto).alias(f"_h{n}") for n in range(1, LEVELS + 1)]
    x = x.select("*", *opened)
    path, latest = [], F.lit(-1)
    for n in range(1, LEVELS + 1):  # a heading is open unless one of a higher level came after it
        at = F.coalesce(F.col(f"_h{n}.i"), F.lit(-1))
        path.append(F.when(at > latest, F.col(f"_h{n}.title")))
        latest = F.greatest(latest, at)
    x = x.filter("_body").select(*keep, "_row", "section", "block", "i", "line", "kind", F.array_compact(F.array(*path)).alias("path"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")  # of one block
    return x.groupBy(*keep, "_row", "section", "block").agg(F.first("path").alias("path"), body.alias("text"), F.bool_and(F.col("kind") == "table").alias("is_table"))


def packed(pieces: Column, limit: Column, joint: str = _JOINT, count_joint: bool = True) -> Column:
    """Neighbouring pieces joined while they fit the limit; a piece over it stands alone."""
    extra = len(joint) if count_joint else 0

    def step(s: Column, p: Column) -> Column:
        fits = (s["n"] > 0) & (s["size"] + extra + F.length(p) <= limit)
        done = F.when(fits | (s["n"] == 0), s["done"]).otherwise(F.concat(s["done"], F.array(s["body"])))
        return F.struct(
            done.alias("done"), F.when(fits, F.concat(s["body"], F.lit(joint), p)).otherwise(p).alias("body"), F.when(fits, s["size"] + extra + F.length(p)).otherwise(F.length(p)).alias("size"), (s["n"] + 1).alias("n")
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("body"), F.lit(0).alias("size"), F.lit(0).alias("n"))
    return F.aggregate(pieces, zero, step, lambda s: F.when(s["n"] == 0, s["done"]).otherwise(F.concat(s["done"], F.array(s["body"]))))


def _cut(block: Column, room: Column) -> Column:
    """A block of text as groups of lines that fit; a line that doesn't, in equal cuts."""
    cuts = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(line) / room).cast("int") - 1)), lambda k: F.substring(line, k * room + 1, room))
    return packed(F.flatten(F.transform(F.split(block, "\n", -1), cuts)), room, "\n")


def _head(path: Column) -> Column:
    rest = F.array_join(F.slice(path, 2, F.greatest(F.size(path), F.lit(1))), " > ")
    return F.concat(path[0], F.when(F.size(path) > 1, F.concat(F.lit("\n"), rest)).otherwise(""), F.lit(_JOINT))


def _joined(units: Column, least: int, most: int) -> Column:
    """Units (path, body) in order; a small one joins what is before it, and what is small takes in what follows, where
    one's path is the other's, its direct parent's or its sibling's, and both fit."""
    tokens = lambda path, body: F.floor((F.length(_head(path)) + F.length(body)) / 4)
    parent = lambda p: F.slice(p, F.lit(1), F.size(p) - 1)

    def step(done: Column, u: Column) -> Column:
        last = F.element_at(done, -1)
        line = F.when((u["path"] != last["path"]) & (F.size(u["path"]) > 1), F.concat(F.element_at(u["path"], -1), F.lit("\n"))).otherwise("")
        both = F.concat(last["body"], F.lit(_JOINT), line, u["body"])
        near = (last["path"] == u["path"]) | (last["path"] == parent(u["path"])) | (parent(last["path"]) == parent(u["path"]))
        small = (tokens(u["path"], u["body"]) < least) | (tokens(last["path"], last["body"]) < least)
        fits = (F.size(done) > 0) & near & small & (tokens(last["path"], both) <= most)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["path"].alias("path"), both.alias("body"))))
        return F.when(F.coalesce(fits, F.lit(False)), grown).otherwise(F.concat(done, F.array(u)))

    return F.aggregate(units, F.array().cast("array<struct<path:array<string>,body:string>>"), step)


def markdown_chunks(docs: DataFrame, id_col: str, title_col: str, text_col: str, least: int = 300, most: int = 1200) -> DataFrame:
    """id, ordinal, path (from the title on; a first heading that repeats it is left out), body of each chunk, of up to
    `most` tokens (four characters each) with its heading lines; tables stay whole. Null and blank texts have no chunks."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(title_col).cast("string"), F.lit("")).alias("_title"), F.col(text_col).cast("string").alias("_text"))
    b = blocks_of(source, F.col("_text"), "_id", "_title")
    again = F.lower(F.trim(F.get("path", F.lit(0)))) == F.lower(F.trim("_title"))
    path = F.concat(F.array("_title"), F.when(again, F.slice("path", F.lit(2), F.size("path"))).otherwise(F.col("path")))
    b = b.withColumn("path", path)
    room = F.greatest(F.lit(1), F.lit(4 * most) - F.length(_head(F.col("path"))))
    pieces = F.when(F.col("is_table") | (F.length("text") <= room), F.array("text")).otherwise(_cut(F.col("text"), room))
    b = b.select("_id", "_row", "section", "block", "path", room.alias("room"), pieces.alias("pieces"))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "pieces"))), lambda x: x["pieces"]))  # of one text, as below
    s = b.groupBy("_id", "_row", "section").agg(F.first("path").alias("path"), F.first("room").alias("room"), in_order.alias("pieces"))
    s = s.select("_id", "_row", "section", "path", packed(F.col("pieces"), F.col("room")).alias("bodies"))
    units = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "path", "bodies"))), lambda x: F.transform(x["bodies"], lambda y: F.struct(x["path"].alias("path"), y.alias("body")))))
    whole = s.groupBy("_id", "_row").agg(units.alias("units"))
    made = whole.select("_id", F.posexplode(_joined(F.col("units"), least, most)).alias("ordinal", "c"))
    return made.select(F.col("_id").alias(id_col), "ordinal", "c.path", "c.body")


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """id, ordinal, length of packed blocks, which end at blank lines and headings (each heading is one) and are packed
    while their sizes fit the limit; a block over it stays whole. Null and blank texts have none."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n", -1)
    heading = lambda x: x.rlike(r"^#{1,6}\s+\S")
    # Headings are set off by blank lines, and so every block is.
    apart = F.array_join(F.transform(lines, lambda x: F.when(heading(x), F.concat(F.lit("\n"), x, F.lit("\n"))).when(F.trim(x) == "", "").otherwise(x)), "\n")
    pieces = F.filter(F.transform(F.split(apart, "\n\n+", -1), lambda x: F.trim(x, F.lit("\n"))), lambda x: x != "")
    made = docs.select(F.col(id_col), F.posexplode(packed(pieces, F.lit(limit), count_joint=False)).alias("ordinal", "body"))
    return made.select(id_col, "ordinal", F.length("body").alias("length"))


def flatten_toc(trees: DataFrame, json_col: str) -> DataFrame:
    """id, title, parent, level, place of every entry of nested JSON trees of any depth; malformed trees give none."""

    def walk(frames):
        for pdf in frames:
            rows = []
            for text in pdf["j"]:
                try:
                    stack = [(json.loads(text), None, 0, 0)]
                except (TypeError, ValueError):
                    continue
                while stack:
                    node, parent, level, place = stack.pop()
                    rows.append((node.get("id"), node.get("title"), parent, level, place))
                    stack.extend((child, node.get("id"), level + 1, n) for n, child in enumerate(node.get("children") or []))
            yield pd.DataFrame(rows, columns=["id", "title", "parent", "level", "place"])

    return trees.select(F.col(json_col).alias("j")).mapInPandas(walk, "id string, title string, parent string, level int, place int")
