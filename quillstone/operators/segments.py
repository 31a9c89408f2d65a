"""Boundaries and blocks: where practice begins in a document, and the three blocks that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import scalars
from .scoring import scored


def doc():
    return Window.partitionBy("doc_id")


def ordered():
    return doc().orderBy("para")


def marked(paras: DataFrame, more: dict[str, str] | None = None, sections: bool = False) -> DataFrame:
    """The features that boundaries are found by, a boolean for each pattern in ``more``, and ``b0``, the first strong boundary of the document."""
    t = F.col("text")
    after = lambda pattern: F.length(F.trim(F.regexp_replace(t, pattern, "")))
    first = lambda pattern: F.regexp_extract(t, pattern, 1)
    f = scored(paras, {"numbered": P.NUMBER, "_main": P.MAIN_NUMBER, "heading": P.KNOWLEDGE_HEADING, "_dotted": P.DOTTED} | (more or {}), sections).withColumns(
        {
            "question": F.col("numbered") & F.when(F.col("numbered"), after(P.NUMBER) >= 6),
            "number": F.when(F.col("numbered"), first(P.NUMBER)),
            "main": F.when(F.col("_main"), F.when(after(P.MAIN_NUMBER) >= 8, first(P.MAIN_NUMBER))),
        }
    )
    leads = {f"{c}{d}": F.lead(c, d).over(ordered()) for c in "qk" for d in (1, 2)}
    f = f.withColumns(leads)
    three = (F.col("q") > F.col("k")) & (F.col("q") >= 2) & (F.col("q1") > F.col("k1")) & (F.col("q1") >= 1) & (F.col("q2") > F.col("k2")) & (F.col("q2") >= 1)
    signal = F.min(F.when(F.col("is_boundary") & ~F.col("_dotted"), F.col("para"))).over(doc())
    return f.withColumn("b0", F.coalesce(signal, F.min(F.when(three, F.col("para"))).over(doc())))


def fold_numbers(rows: Column, strict: bool) -> Column:
    """Paragraphs whose numbers go on from one another. rows: an array of (para, number) in order."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("hits"))

    def step(acc, x):
        n = x["number"]
        begins = (n <= 2) & (F.size(acc["hits"]) == 0) if strict else n <= 2
        takes = (n == acc["last"] + 1) | ((n == 1) & (acc["last"] >= 1)) | begins
        return F.when(takes, F.struct(n.alias("last"), F.array_append(acc["hits"], x["para"]).alias("hits"))).otherwise(acc)

    return F.aggregate(rows, start, step, lambda acc: acc["hits"])


def boundaries(paras: DataFrame, extra: dict[str, Column] | None = None, more: dict[str, str] | None = None, sections: bool = False) -> DataFrame:
    """doc_id, first, last, n, boundary (null where none) and points (question starts), a row for each document; one shuffle.

    extra: further aggregates over a document's paragraphs, by name, which may use whether patterns in ``more`` match and, if
    ``sections`` are asked for, section_type; they come from the same shuffle.
    """
    extra = extra or {}
    f = marked(paras, more, sections)
    rows = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("para", scalars.number(F.col(c)).alias("number")))))
    before = F.col("para") < F.col("b0")
    docs = f.groupBy("doc_id").agg(
        F.min("para").alias("first"), F.max("para").alias("last"), F.count("*").alias("n"), F.first("b0").alias("b0"),
        F.max(F.when(F.col("question") & before, F.col("para"))).alias("found"), F.max(F.when(F.col("heading") & before, F.col("para"))).alias("heading"),
        F.min(F.when(F.col("numbered"), F.col("para"))).alias("b3"), rows("main").alias("main"), rows("number").alias("any"),
        *(c.alias(k) for k, c in extra.items()),
    )
    near = (F.col("b0") - F.col("found") <= F.greatest(F.lit(15), F.floor(F.col("n") / 5))) & (F.coalesce("heading", F.lit(-1)) <= F.col("found"))
    boundary = F.when(F.col("n") < 3, None).when(F.col("b0").isNull(), F.col("b3")).when(near, F.col("found")).otherwise(F.col("b0"))
    main = fold_numbers(F.col("main"), True)
    points = F.when(F.size(main) >= 3, main).otherwise(fold_numbers(F.col("any"), False))
    return docs.select("doc_id", "first", "last", "n", boundary.alias("boundary"), points.alias("points"), *extra)


def block(ord: int, marker: str, start: Column, end: Column) -> Column:
    return F.struct(F.lit(ord).alias("ord"), F.lit(marker).alias("marker"), start.cast("int").alias("start_para"), end.cast("int").alias("end_para"))


def share(points: Column) -> Column:
    """How many of the points come before the last block: seven tenths, halves to even, one at least."""
    return F.greatest(F.lit(1), F.rint(F.size(points) * F.lit(0.7)).cast("int"))


def before(point: Column) -> Column:
    """The block of knowledge before ``point``; 1 to 0 if there is none."""
    empty = point <= F.col("first")
    return block(1, P.MARKER_KNOWLEDGE, F.when(empty, 1).otherwise(F.col("first")), F.when(empty, 0).otherwise(point - 1))


def cut_at(b: Column) -> Column:
    """An array with the two or three blocks that a boundary makes of a row of ``boundaries``."""
    last, later = F.col("last"), F.filter("points", lambda p: p >= b)
    by_question = F.when(share(later) < F.size(later), F.get(later, share(later)) - 1).otherwise(last)
    by_share = b + ((last - b) * F.lit(0.7)).cast("int")
    cut = F.greatest(F.when(F.size(later) >= 2, by_question).otherwise(by_share), b)
    return F.array_compact(F.array(before(b), block(2, P.MARKER_DRILL, b, cut), F.when(cut < last, block(3, P.MARKER_CONSOLIDATION, cut + 1, last))))


def blocks(found: DataFrame) -> DataFrame:
    """The blocks of documents with a boundary: ord, marker, start_para, end_para; an empty block is 1 to 0."""
    return gathered(found).select("doc_id", F.explode_outer("made").alias("b")).select("doc_id", "b.*")


def gathered(found: DataFrame) -> DataFrame:
    """``found`` with made, an array of those blocks, for documents with a boundary."""
    return found.filter(F.col("boundary").isNotNull()).withColumn("made", cut_at(F.col("boundary")))
