"""The rules that tell paragraphs apart one by one, and the split that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .segments import block, ordered, share
from .tiers import protected, reading_events

#: Below this a paragraph's class is unsure.
SURE = 70


def certain(t: Column) -> Column:
    """The class of a paragraph that says what it is, with its confidence; null for others."""
    said = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    title = (F.length(t) < 30) & ~t.rlike(P.NUMBERED_QUESTION)
    header = t.rlike(P.KNOWLEDGE_HEADER)
    return (
        F.when(t.rlike(P.TYPE_MARKER), said("practice", 100)).when(t.rlike(P.EXAMPLE), said("example", 100)).when(t.rlike(P.SUMMARY), said("knowledge", 95))
        .when(t.rlike(P.ANSWER_HEADER) | t.rlike(P.PRACTICE_HEADER), said("practice", 95)).when(header & t.rlike(P.CONCEPT), said("knowledge", 95)).when(header & title, said("knowledge", 90))
        .when(t.rlike(P.OPTION), said("practice", 90)).when(t.rlike(P.BLANK) | t.rlike(P.FILL_IN), said("practice", 85)).when(t.rlike(P.SEPARATOR) | (t == ""), said("other", 100))
    )


def confidence(t: Column, ratio: Column) -> Column:
    """How much a paragraph that doesn't say what it is looks like knowledge, before what stands in front of it counts."""
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    concepts = F.regexp_count(t, F.lit(P.CONCEPT))
    return (
        F.lit(50) + points(t.rlike(P.STRUCTURE_HEADER), 30) + points(t.rlike(P.NUMBERED_QUESTION), 30) + F.when(concepts >= 2, 25).when(concepts >= 1, 15).otherwise(0)
        + points(t.rlike(P.EXAM_YEAR), -20) + F.when(F.length(t) > 200, 10).when(F.length(t) < 20, -10).otherwise(0) + F.when(ratio < 0.3, 5).when(ratio > 0.7, -10).otherwise(0)
    )


def guessed(t: Column) -> Column:
    """The class of a paragraph of which the rules aren't sure, with a likeness."""
    said = lambda category, likeness: F.struct(F.lit(category).alias("category"), F.lit(likeness).alias("confidence"))
    return (
        F.when(t.rlike(P.NUMBERED_QUESTION), said("practice", 0.8)).when(t.rlike(P.CONCEPT), said("knowledge", 0.7)).when(t.rlike(P.OPTION) | t.rlike(P.BLANK), said("practice", 0.85))
        .when(F.length(t) > 150, said("knowledge", 0.6)).when(F.length(t) < 20, said("practice", 0.55)).otherwise(said("knowledge", 0.5))
    )


CLASS = "array<struct<para:int,category:string,confidence:double>>"


def collected(paras: DataFrame) -> DataFrame:
    """doc_id, first, last, events (of reading passages) and classes (para, category, confidence), a row for each document.

    The class of a paragraph that doesn't say what it is also depends on the last class that was sure, so that the
    paragraphs of a document are walked in order.
    """
    t = F.col("text")
    f = paras.withColumn("ratio", F.percent_rank().over(ordered()))
    f = f.withColumns({"said": certain(t), "points": confidence(t, F.col("ratio")), "guess": guessed(t), "asks": t.rlike(P.NUMBERED_QUESTION)})
    d = f.groupBy("doc_id").agg(F.min("para").alias("first"), F.max("para").alias("last"), reading_events().alias("events"), F.array_sort(F.collect_list(F.struct("para", "said", "points", "guess", "asks"))).alias("rows"))
    start = F.struct(F.lit("").alias("before"), F.array().cast(CLASS).alias("out"))

    def step(acc, x):
        n = F.greatest(F.lit(0), F.least(F.lit(100), x["points"] + F.when(acc["before"] == "knowledge", 10).when(acc["before"] == "practice", -10).otherwise(0)))
        category = F.when(x["said"].isNotNull(), x["said"]["category"]).when(n >= 80, "knowledge").when(x["asks"], "practice").when(n >= 60, "knowledge").otherwise("other")
        n = F.coalesce(x["said"]["confidence"], n)
        sure = (category != "other") & (n >= SURE)
        row = F.struct(x["para"].alias("para"), F.when(sure, category).otherwise(x["guess"]["category"]).alias("category"), F.when(sure, n / 100).otherwise(x["guess"]["confidence"]).cast("double").alias("confidence"))
        return F.struct(F.when(sure, category).otherwise(acc["before"]).alias("before"), F.array_append(acc["out"], row).cast(CLASS).alias("out"))

    return d.select("doc_id", "first", "last", "events", F.aggregate("rows", start, step, lambda acc: acc["out"]).alias("classes"))


def classified(paras: DataFrame) -> DataFrame:
    """doc_id, para, category and confidence."""
    return collected(paras).select("doc_id", F.explode("classes").alias("c")).select("doc_id", "c.*")


def split(paras: DataFrame, knowledge: str = P.MARKER_KNOWLEDGE, consolidation: str = P.MARKER_CONSOLIDATION) -> DataFrame:
    """doc_id, ord, marker, start_para, end_para: knowledge to its last paragraph, then seven tenths of the practice behind it, then the rest."""
    places = lambda *kinds: F.transform(F.filter("classes", lambda c: c["category"].isin(*kinds)), lambda c: c["para"])
    d = collected(paras).withColumns({"known": places("knowledge", "example"), "asked": places("practice")})
    first, last = F.col("first"), F.col("last")
    share_of = lambda span: (span * F.lit(0.7)).cast("int")
    d = d.withColumn("k_end", F.coalesce(F.array_max("known"), first + ((last - first) * F.lit(0.3)).cast("int")))
    behind = F.col("k_end") + 1
    d = d.withColumns({"after": F.filter("asked", lambda p: p >= behind), "p_start": F.greatest(F.coalesce(F.array_min("asked"), behind), behind), "p_end": F.coalesce(F.array_max("asked"), "last")})
    d = d.withColumn("p_end", F.when((F.col("p_start") > last) | (F.col("p_end") < F.col("p_start")), last).otherwise(F.col("p_end"))).withColumn("p_start", F.least("p_start", "last"))
    many, span = F.size("after") >= 3, last - behind
    cut = F.get("after", share(F.col("after"))) - 1
    d = d.withColumns(
        {
            "t": F.when(many, F.coalesce(cut, "p_end")).when(span <= 0, last).otherwise(F.least(behind + share_of(span), last)),
            "s": F.when(many, F.col("p_start")).when(span <= 0, last + 1).otherwise(behind),
            "e": F.when(many, F.col("p_end")).otherwise(last),
        }
    )
    d = d.withColumn("t", F.least("t", "e", "last"))
    filled = (F.col("t") >= F.col("s")) & (F.col("s") <= last)
    made = F.array(
        block(1, knowledge, first, F.col("k_end")), block(2, P.MARKER_DRILL, F.when(filled, F.col("s")).otherwise(1), F.when(filled, F.col("t")).otherwise(0)), block(3, consolidation, F.least(F.col("t") + 1, last), last)
    )
    return protected(d.withColumn("made", made), first).select("doc_id", F.explode_outer("made").alias("b")).select("doc_id", "b.*")
