"""Checks of blocks, the rows that blocks are assembled from, and pairs of knowledge runs with examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P


def class_marker(marker: Column) -> Column:
    """The marker that stands for ``marker`` in the template for classes."""
    return F.when(marker == P.MARKER_KNOWLEDGE, P.CLASS_KNOWLEDGE).when(marker == P.MARKER_CONSOLIDATION, P.CLASS_CONSOLIDATION).otherwise(marker)


def for_class(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the markers of the template for classes."""
    return blocks.withColumn("marker", class_marker(F.col("marker")))


def validated(blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """What is wrong with each document's blocks: not three of them, one reversed, one out of range, one over another."""
    before = F.lag("end_para").over(Window.partitionBy("doc_id").orderBy("ord"))
    b = blocks.withColumn("before", before).join(extents.select("doc_id", F.col("start_para").alias("first"), F.col("end_para").alias("last")), "doc_id")
    s, e = F.col("start_para"), F.col("end_para")
    return b.groupBy("doc_id").agg(
        (F.count("*") != 3).alias("not_three"), F.bool_or(s > e).alias("reversed"), F.bool_or((s < F.col("first")) | (e > F.col("last"))).alias("outside"), F.coalesce(F.bool_or(s <= F.col("before")), F.lit(False)).alias("overlapping")
    )


def validated_rows(found: DataFrame) -> DataFrame:
    """What ``validated`` says, for rows that have a document's blocks (made, in their order) and its extent (first, last) already."""
    s, e = (lambda b: b["start_para"]), (lambda b: b["end_para"])
    over = F.exists(F.transform("made", lambda b, i: (i > 0) & (s(b) <= F.get("made", i - 1)["end_para"])), lambda x: F.coalesce(x, F.lit(False)))
    return found.select(
        "doc_id", (F.size("made") != 3).alias("not_three"), F.exists("made", lambda b: s(b) > e(b)).alias("reversed"), F.exists("made", lambda b: (s(b) < F.col("first")) | (e(b) > F.col("last"))).alias("outside"), over.alias("overlapping")
    )


def faults(b: Column, before: Column, first: Column, last: Column) -> list[Column]:
    """What is wrong with a block behind one that ends at ``before``, in a document from ``first`` to ``last``; null for what isn't."""
    s, e, marker, text = b["start_para"], b["end_para"], b["marker"], lambda c: c.cast("string")
    return [
        F.when(s > e, F.concat(marker, F.lit(" start > end："), text(s), F.lit(">"), text(e))),
        F.when((s < first) | (e > last), F.concat(marker, F.lit(P.BLOCK_OUTSIDE), text(s), F.lit("-"), text(e), F.lit(P.BLOCK_RANGE), text(first), F.lit("-"), text(last))),
        F.when(s <= before, F.concat(marker, F.lit(P.BLOCK_OVER), text(s), F.lit(", prev_end="), text(before))),
    ]


def errors(blocks: DataFrame, extents: DataFrame) -> DataFrame:
    """doc_id, valid and errors (lines, as reports print them) for each document of ``blocks``, one without paragraphs included.

    In order: how many blocks there are, if not three, then for each block whether it is reversed, out of range, or over the one before.
    """
    before = F.lag("end_para").over(Window.partitionBy("doc_id").orderBy("ord"))
    b = blocks.withColumn("before", before).join(extents.select("doc_id", F.col("start_para").alias("first"), F.col("end_para").alias("last")), "doc_id", "left")
    said = F.array(*faults(F.struct("marker", "start_para", "end_para"), F.col("before"), F.col("first"), F.col("last")))
    d = b.groupBy("doc_id").agg(F.first("first").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", F.array_compact(said).alias("said")))).alias("each"))
    count = F.when(F.col("n") != 3, F.array(F.concat(F.lit(P.BLOCK_COUNT), F.col("n").cast("string")))).otherwise(F.array().cast("array<string>"))
    every = F.when(F.col("first").isNull(), F.array(F.lit(P.NO_ROWS))).otherwise(F.concat(count, F.flatten(F.transform("each", lambda x: x["said"]))))
    return d.select("doc_id", (F.size(every) == 0).alias("valid"), F.array_join(every, "\n").alias("errors"))


def assembled(paras: DataFrame, blocks: DataFrame) -> DataFrame:
    """The paragraphs of each block in the order of the output; pos counts them from 1. The join is on doc_id, the range a filter."""
    # few blocks are hashed, so that the many texts needn't be sorted for the join
    rows = paras.join(blocks.hint("shuffle_hash"), "doc_id").filter(F.col("para").between(F.col("start_para"), F.col("end_para")))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "para"))
    return rows.select("doc_id", pos.alias("pos"), "marker", "para", "text")


def paired(runs: DataFrame, examples: DataFrame, reach: int = 20) -> DataFrame:
    """Each run with the nearest example at or after its end that no earlier run has taken; null where none is within ``reach``.

    runs: doc_id, start_para, end_para. examples: doc_id, para. As both are in order, the examples left over are those
    behind the last one taken, so that the fold keeps only that one.
    """
    r = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_para", "end_para"))).alias("runs"))
    e = examples.groupBy("doc_id").agg(F.array_sort(F.collect_list("para")).alias("examples"))
    start = F.struct(F.lit(0).alias("taken"), F.array().cast("array<struct<start_para:int,end_para:int,example:int>>").alias("out"))

    def step(acc, run):
        free = F.array_min(F.filter(F.coalesce("examples", F.array().cast("array<int>")), lambda p: (p > acc["taken"]) & (p >= run["end_para"]) & (p <= run["end_para"] + reach)))
        return F.struct(F.coalesce(free, acc["taken"]).alias("taken"), F.array_append(acc["out"], F.struct(run["start_para"].alias("start_para"), run["end_para"].alias("end_para"), free.alias("example"))).alias("out"))

    pairs = F.explode(F.aggregate("runs", start, step, lambda acc: acc["out"]))
    return r.join(e, "doc_id", "left").select("doc_id", pairs.alias("p")).select("doc_id", "p.*")
