"""Filling a template: blocks that cut no table, anchors in the template, and the rows of the filled document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from .rows import doc

#: Places of markers in the layout; blocks are pasted from the last place to the first. Fixed values.
PLACES = {"二、知识回顾": 2, "知识回顾": 2, P.MARKER_KNOWLEDGE: 3, P.CLASS_KNOWLEDGE: 3, P.MARKER_DRILL: 4, "五、归纳总结": 5, "归纳总结": 5, P.MARKER_CONSOLIDATION: 6, "巩固练习": 6, P.CLASS_CONSOLIDATION: 6, "出门测试": 6}

#: Where fields stand in the cover's table for one pupil (row, column), and what they replace in the template for a class. Fixed values.
CELLS = {"subject": (1, 1), "grade": (1, 3), "topic": (2, 2), "handout_type": (2, 4), "objectives": (3, 2), "difficulties": (4, 2)}
SUBJECT = "科 目："
PLACEHOLDERS = {"grade": "五年级", "subject": "数学", "topic": "第二单元 因数与倍数", "objectives": "掌握重难点题型", "difficulties": "质数和合数的概念以及综合运用", "authors": "审核老师"}


def place(marker: Column) -> Column:
    """The marker's place in the layout; 0 for one that has none."""
    return F.coalesce(*(F.when(marker == m, n) for m, n in PLACES.items()), F.lit(0))


def table_islands(spans: DataFrame) -> DataFrame:
    """``spans`` (doc_id, start_para, end_para) of tables, nested and overlapping ones made one, so that no paragraph is in two."""
    w = doc().orderBy("start_para", "end_para")
    reached = F.max("end_para").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("start_para") > reached, F.lit(True)).cast("int"))
    numbered = opened.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start_para").alias("start_para"), F.max("end_para").alias("end_para")).drop("island")


def widened(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, ord, marker, start_para, end_para), those that begin or end inside a table widened to all of it.

    Islands don't meet, so that an end that was widened is in no further table. Ends and islands stand in one order of
    paragraphs: an end looks back at the last island that has begun, which costs a sort and no pairs. Empty blocks stay.
    """
    ends = F.array(F.struct(F.lit(0).alias("which"), F.col("start_para").alias("at")), F.struct(F.lit(1).alias("which"), F.col("end_para").alias("at")))
    own = F.struct(*blocks.columns)
    none = F.lit(None).cast("struct<first:int,last:int>")
    # blocks go along with their ends, so that what makes them runs once
    points = blocks.select("doc_id", "ord", own.alias("own"), F.explode_outer(ends).alias("e")).select("doc_id", "e.at", F.lit(1).alias("kind"), "ord", "e.which", "own", none.alias("island"))
    opened = table_islands(spans).select("doc_id", F.col("start_para").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("which"), F.lit(None).cast(points.schema["own"].dataType).alias("own"), F.struct(F.col("start_para").cast("int").alias("first"), F.col("end_para").cast("int").alias("last")).alias("island"))
    w = doc().orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = points.unionByName(opened).withColumn("island", F.last("island", ignorenulls=True).over(w)).filter("kind = 1")
    inside = F.col("island.last") >= F.col("at")
    to = F.when(inside, F.when(F.col("which") == 0, F.col("island.first")).otherwise(F.col("island.last"))).otherwise(F.col("at"))
    moved = met.groupBy("doc_id", "ord").agg(F.first("own").alias("own"), F.min(F.when(F.col("which") == 0, to)).alias("s"), F.max(F.when(F.col("which") == 1, to)).alias("e"))
    filled = (F.col("own.start_para") > 0) & (F.col("own.end_para") >= F.col("own.start_para"))
    changed = {"start_para": F.when(filled, F.col("s")).otherwise(F.col("own.start_para")), "end_para": F.when(filled, F.col("e")).otherwise(F.col("own.end_para"))}
    return moved.select(*(changed.get(c, F.col(f"own.{c}")).alias(c) for c in blocks.columns))


def anchors(templates: DataFrame, markers: DataFrame) -> DataFrame:
    """template, marker and at, the first row of the template that begins with the marker; a row is the anchor of one marker at most.

    templates: template, pos and text. markers: template, rank and marker; of those that a row begins with and that have no
    anchor yet, the one of least rank gets it. Only rows that begin with some marker are gathered.
    """
    met = templates.join(markers, "template").filter(F.col("text").startswith(F.col("marker")))
    rows = met.groupBy("template", "pos").agg(F.array_sort(F.collect_list(F.struct("rank", "marker"))).alias("said"))
    ordered = rows.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("rows"))
    start = F.array().cast("array<struct<marker:string,at:int>>")

    def step(taken, row):
        free = F.get(F.filter(row["said"], lambda m: ~F.exists(taken, lambda t: t["marker"] == m["marker"])), F.lit(0))["marker"]
        return F.when(free.isNotNull(), F.array_append(taken, F.struct(free.alias("marker"), row["pos"].cast("int").alias("at")))).otherwise(taken)

    return ordered.select("template", F.explode(F.aggregate("rows", start, step)).alias("a")).select("template", "a.*")


def pasted(blocks: DataFrame) -> DataFrame:
    """Blocks that have rows to paste."""
    return blocks.filter((F.col("start_para") > 0) & (F.col("end_para") >= F.col("start_para")))


def missing_anchors(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, ord and marker of blocks (with template) whose marker has no anchor in their template; empty blocks look for none."""
    return pasted(blocks).join(found, ["template", "marker"], "left_anti").select("doc_id", "ord", "marker")


def filled_rows(paras: DataFrame, blocks: DataFrame, templates: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, pos (from 1), origin (template or source), para (of its origin) and text of each document's filled template.

    blocks: doc_id, template, ord, marker, start_para and end_para. The rows of a block stand behind its anchor; of blocks
    with the same anchor that pasted last stands first: those of earlier places in the layout, then later blocks. Blocks
    without an anchor are left out.
    """
    # a document's template rows and blocks come from one row and meet its paragraphs in one join, so that what makes the blocks runs once
    kind = "array<struct<at:int,layer:int,place:int,turn:int,start_para:int,end_para:int,text:string>>"
    anchored = blocks.join(F.broadcast(found), ["template", "marker"], "left").withColumn("layer", F.lit(1))
    own = F.struct("at", "layer", place(F.col("marker")).alias("place"), (-F.col("ord")).alias("turn"), "start_para", "end_para", F.lit(None).cast("string").alias("text"))
    has_rows = (F.col("start_para") > 0) & (F.col("end_para") >= F.col("start_para"))
    docs = anchored.groupBy("doc_id", "template").agg(F.collect_list(F.when(F.col("at").isNotNull() & has_rows, own)).cast(kind).alias("own"))
    given = F.struct(F.col("pos").alias("at"), F.lit(0).alias("layer"), F.lit(0).alias("place"), F.lit(0).alias("turn"), F.col("pos").alias("start_para"), F.col("pos").alias("end_para"), "text")
    frames = templates.groupBy("template").agg(F.collect_list(given).cast(kind).alias("given"))
    items = docs.join(F.broadcast(frames), "template").select("doc_id", F.explode_outer(F.concat("given", "own")).alias("i")).select("doc_id", "i.*")
    p = paras.select(F.col("doc_id").alias("_doc"), F.col("para").alias("_para"), F.col("text").alias("_text"))
    # few rows are hashed, so that the many texts needn't be sorted for the join
    met = items.hint("shuffle_hash").join(p, (F.col("doc_id") == F.col("_doc")) & (F.col("layer") == 1) & F.col("_para").between(F.col("start_para"), F.col("end_para")), "left")
    of_template = F.col("layer") == 0
    rows = met.filter(of_template | F.col("_para").isNotNull()).withColumns({"para": F.when(of_template, F.col("start_para")).otherwise(F.col("_para")), "text": F.when(of_template, F.col("text")).otherwise(F.col("_text"))})
    pos = F.row_number().over(doc().orderBy("at", "layer", "place", "turn", "para"))
    return rows.select("doc_id", pos.alias("pos"), F.when(of_template, "template").otherwise("source").alias("origin"), "para", "text")


def trimmed(rows: DataFrame) -> DataFrame:
    """Filled rows with one empty row of each run left, the last, from the row that names the knowledge block on; all rows before it stay, as they place it."""
    w = doc().orderBy("pos")
    opens = F.min(F.when(F.col("text").contains(P.MARKER_KNOWLEDGE), F.col("pos"))).over(doc())
    f = rows.withColumns({"opens": F.coalesce(opens, F.max("pos").over(doc())), "following": F.lead("text").over(w)})
    kept = f.filter((F.col("pos") < F.col("opens")) | ~((F.trim("text") == "") & F.coalesce(F.trim("following") == "", F.lit(False))))
    return kept.select("doc_id", F.row_number().over(w).alias("pos"), "origin", "para", "text")


def cover_cells(fields: DataFrame) -> DataFrame:
    """doc_id, row, col and text of the cells of a cover from fields (doc_id and those of CELLS); a null field is empty."""
    text = lambda name: F.concat(F.lit(SUBJECT if name == "subject" else ""), F.coalesce(name, F.lit("")))
    each = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), text(k).alias("text")) for k, (r, c) in CELLS.items()))
    return fields.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*")


def covered(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Filled rows with the placeholders of the template's own rows replaced by a document's fields, in the order of PLACEHOLDERS; empty and null fields replace nothing."""
    known = [k for k in PLACEHOLDERS if k in fields.columns]
    f = rows.join(fields.select("doc_id", F.struct(*known).alias("f")), "doc_id", "left")
    text = F.col("text")
    for k in known:
        value = F.col(f"f.{k}")
        text = F.when(F.coalesce(value, F.lit("")) != "", F.replace(text, F.lit(PLACEHOLDERS[k]), value)).otherwise(text)
    return f.select(*(F.when(F.col("origin") == "template", text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in rows.columns))
