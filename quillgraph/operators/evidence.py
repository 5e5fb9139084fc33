"""Evidence that is shown for the citations of an answer, within a budget.

A text that an earlier source of the answer has too is a pointer to it, but only while that copy is shown whole. Sources
get fair parts of the budget, and show their texts from the first on while their parts last. Which copies are whole
depends on the parts, and these on what points: pointers whose copy is cut are taken back, and only ever that, until none
is left. Each round is the same few aggregations over all answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut


def fair_parts(sizes: DataFrame, budget: int) -> DataFrame:
    """answer, source, part of (answer, source, size): every source up to a level that all who ask for more share, and of
    the units left over one each from the first source on."""
    by_size = Window.partitionBy("answer").orderBy("size", "source")
    w = sizes.withColumn("before", F.coalesce(F.sum("size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("asking", F.count("*").over(Window.partitionBy("answer")) - F.row_number().over(by_size) + 1)
    reach = F.floor((F.lit(budget) - F.col("before")) / F.col("asking"))  # the level, if all smaller ones get what they ask
    level = w.filter(F.col("size") > reach).groupBy("answer").agg(F.min_by(reach, F.struct("size", "source")).alias("level"), F.min_by(F.col("before"), F.struct("size", "source")).alias("met"), F.max("asking").alias("short"))
    x = sizes.join(level, "answer", "left")
    left_over = F.lit(budget) - F.col("met") - F.col("level") * F.col("short")
    place = F.row_number().over(Window.partitionBy("answer", F.col("size") > F.col("level")).orderBy("source"))
    return x.select("answer", "source", F.when(F.col("level").isNull() | (F.col("size") <= F.col("level")), F.col("size")).otherwise(F.col("level") + (place <= left_over).cast("long")).alias("part"))


def capped(texts: DataFrame, budget: int) -> DataFrame:
    """answer, source, pos, chars, same_as, state of each text (answer, source in order, pos, text): the characters that
    are shown; the source that it points to instead, if any; and `whole`, `cut`, `omitted` (nothing fits) or `same`.
    Null texts are empty, and whole. Windows are over the sources of an answer and the texts of a source."""
    length = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = cut(texts.select("answer", "source", "pos", length.alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")))
    first = rows.groupBy("answer", "h").agg(F.min(F.struct("source", "pos")).alias("f"))
    rows = cut(rows.join(first, ["answer", "h"]).select("answer", "source", "pos", "n", F.when(F.col("f.source") < F.col("source"), F.col("f")).alias("to")))
    while True:
        sizes = rows.groupBy("answer", "source").agg(F.sum(F.when(F.col("to").isNull(), F.col("n")).otherwise(0)).alias("size"))
        own = rows.filter(F.col("to").isNull()).join(fair_parts(sizes, budget), ["answer", "source"])
        before = F.coalesce(F.sum("n").over(Window.partitionBy("answer", "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shown = cut(own.select("answer", "source", "pos", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("part") - before)).alias("chars")))
        partial = shown.filter("chars < n").select("answer", F.struct("source", "pos").alias("to"), F.lit(True).alias("broken"))
        checked = cut(rows.join(partial, ["answer", "to"], "left"))
        if checked.filter("broken").isEmpty():
            break
        rows = checked.withColumn("to", F.when(F.col("broken").isNull(), F.col("to"))).drop("broken")
    state = F.when(F.col("chars") == F.col("n"), "whole").when(F.col("chars") > 0, "cut").otherwise("omitted")
    shown = shown.select("answer", "source", "pos", "chars", F.lit(None).cast("long").alias("same_as"), state.alias("state"))
    return shown.unionByName(rows.filter(F.col("to").isNotNull()).select("answer", "source", "pos", F.lit(0).cast("long").alias("chars"), F.col("to.source").cast("long").alias("same_as"), F.lit("same").alias("state")))
