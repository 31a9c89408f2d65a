"""What a remote model is asked and what it answers: samples of documents, and replies read, checked and made into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import scalars
from . import candidates
from .rows import doc, ordered
from .segments import block

#: Candidates of a kind in a question, and paragraphs around each that go with it.
ASKED, AROUND = 5, 10
#: Paragraphs, characters of each, and characters of all in a sample for objectives; characters of a paragraph in one for blocks.
SAMPLE_ROWS, SAMPLE_LINE, SAMPLE, SPLIT_LINE = 150, 100, 3_000, 150
#: Kinds of block in replies, in the order of the output, with their markers. Fixed values.
KINDS = {"knowledge": P.MARKER_KNOWLEDGE, "practice": P.MARKER_DRILL, "consolidation": P.MARKER_CONSOLIDATION}


def json_text(reply: Column) -> Column:
    """From the first opening brace of a reply to its last closing one; all of it where there is no such part."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(reply)


def between(reply: Column, head: str, end: str | None = None) -> Column:
    """What stands behind a heading, to before ``end`` or the reply's end; empty if the heading isn't there."""
    stop = f"(?={end}|\\z)" if end else r"\z"
    return F.trim(F.regexp_replace(F.regexp_extract(reply, rf"(?s){head}\s*(.*?){stop}", 1), r"^\s+|\s+$", ""))


def review_sample(paras: DataFrame, found: DataFrame, asked: int = ASKED, around: int = AROUND) -> DataFrame:
    """doc_id, para and head of the paragraphs, not empty, around the candidates that a review asks about, each once.

    A paragraph is taken if some centre is no further than ``around`` numbers away, which a window over the numbers of
    paragraphs and centres together tells, however many centres there are: no pairs are made.
    """
    chosen = candidates.chosen(found)
    of_kind = lambda name: F.slice(F.array_distinct(F.transform(name, lambda c: c["para"])), 1, asked)
    at = F.array_union(F.concat(of_kind("practices"), of_kind("consolidations")), F.array_compact(F.when(F.col("practice").isNotNull(), F.array("practice.para", "consolidation.para")).otherwise(F.array().cast("array<int>"))))
    centres = chosen.select("doc_id", F.explode(at).alias("para")).select("doc_id", "para", F.lit(None).cast("string").alias("text"), F.lit(1).alias("centre"))
    every = paras.select("doc_id", "para", "text", F.lit(0).alias("centre")).unionByName(centres)
    near = F.max("centre").over(ordered().rangeBetween(-around, around)) == 1
    kept = every.withColumn("near", near).filter("near AND centre = 0 AND trim(text) <> ''")
    return kept.select("doc_id", "para", scalars.short(F.col("text"), 120).alias("head"))


REVIEW = "practice_start string, consolidation_start string, reason string, _broken string"


def reviews(replies: DataFrame) -> DataFrame:
    """doc_id, practice, consolidation (null where the reply has no whole number) and reason, for replies (doc_id, reply) that are JSON."""
    read = F.from_json(json_text(F.col("reply")), REVIEW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = replies.select("doc_id", read.alias("r")).filter("r IS NOT NULL AND r._broken IS NULL")
    whole = lambda c: F.regexp_extract(F.trim(c), r"^([+-]?[0-9]{1,9})$", 1).try_cast("int")
    return rows.select("doc_id", whole(F.col("r.practice_start")).alias("practice"), whole(F.col("r.consolidation_start")).alias("consolidation"), F.trim(F.coalesce("r.reason", F.lit(""))).alias("reason"))


def reviewed_blocks(found: DataFrame, replies: DataFrame) -> DataFrame:
    """doc_id, source (review or offline), ord, marker, start_para and end_para.

    A reply (doc_id, reply; one for a document) counts if both its picks are candidates of the document or its choice, are
    in order and inside the document, and if its three blocks are sound; other documents keep their own choice. As a
    document's candidates are few and stand in its row, they are looked up there, behind one join of a row with a row.
    """
    p, c, first, last = F.col("r.practice"), F.col("r.consolidation"), F.col("first"), F.col("last")
    f = candidates.built(found).join(reviews(replies).select("doc_id", F.struct("practice", "consolidation").alias("r")), "doc_id", "left")
    named = lambda at, kind, choice: F.exists("said", lambda x: (x["kind"] == kind) & (x["para"] == at)) | F.coalesce(F.col(f"{choice}.para") == at, F.lit(False))
    # with practice at the first paragraph the block of knowledge would lie over it, and no such blocks are taken
    sound = (first < p) & (p < c) & (c <= last) & named(p, candidates.PRACTICE, "practice") & named(c, candidates.CONSOLIDATION, "consolidation")
    asked = F.array(block(1, P.MARKER_KNOWLEDGE, first, p - 1), block(2, P.MARKER_DRILL, p, c - 1), block(3, P.MARKER_CONSOLIDATION, c, last))
    taken = F.coalesce(sound, F.lit(False))
    made = f.select("doc_id", F.when(taken, "review").otherwise("offline").alias("source"), F.explode_outer(F.when(taken, asked).otherwise(F.col("made"))).alias("b"))
    return made.select("doc_id", "source", "b.*")


def reply_blocks(replies: DataFrame, extents: DataFrame) -> DataFrame:
    """doc_id, ord, marker, start_para and end_para from replies (doc_id, reply) that name a start for two kinds of block or more.

    The last start of a kind counts; one that is no whole number but 0 counts as none. Each block ends before the next start,
    the last one with the document; those that this leaves empty are dropped. ord counts the kinds, whatever the order of starts.
    """
    read = F.from_json(json_text(F.col("reply")), "blocks array<struct<type:string,start_para:string>>, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = replies.select("doc_id", read.alias("r")).filter("r._broken IS NULL").select("doc_id", F.posexplode("r.blocks").alias("nth", "b"))
    start = F.when(F.col("b.start_para").rlike("^[0-9]{1,9}$"), F.col("b.start_para").try_cast("int"))
    named = rows.select("doc_id", "nth", F.col("b.type").alias("kind"), start.alias("start_para")).filter("kind <> '' AND start_para > 0")
    last = named.groupBy("doc_id", "kind").agg(F.max_by("start_para", "nth").alias("start_para"), F.min("nth").alias("nth"))
    w = doc().orderBy("start_para", "nth")
    ends = last.withColumns({"n": F.count("*").over(doc()), "following": F.lead("start_para").over(w)}).filter("n >= 2")
    ends = ends.join(extents.select("doc_id", F.col("end_para").alias("last")), "doc_id").withColumn("end_para", F.coalesce(F.col("following") - 1, "last").cast("int"))
    of = lambda values: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in values.items()))
    made = ends.withColumns({"ord": of({k: F.lit(n) for n, k in enumerate(KINDS, 1)}), "marker": of({k: F.lit(m) for k, m in KINDS.items()})})
    return made.filter("ord IS NOT NULL AND end_para >= start_para").select("doc_id", "ord", "marker", "start_para", "end_para")


def covers(indices: Column, n: Column) -> Column:
    """Whether arrays of numbers, together, have all of 0 to n - 1, whatever is outside left out."""
    inside = F.filter(F.flatten(indices), lambda i: (i >= 0) & (i < n))
    return F.array_sort(F.array_distinct(inside)) == F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def objectives_sample(paras: DataFrame, rows: int = SAMPLE_ROWS, line: int = SAMPLE_LINE, size: int = SAMPLE) -> DataFrame:
    """doc_id and sample: the first ``line`` characters of those of the first ``rows`` paragraphs that aren't empty, in ``size`` characters.

    A running sum of lengths, line ends included, tells where each line would begin; the last one that does so in time is cut.
    No more than ``size`` characters of a document are ever gathered.
    """
    w = ordered()
    head = paras.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= rows)
    lines = head.select("doc_id", "para", F.substring(F.trim("text"), 1, line).alias("line")).filter("line <> ''")
    begun = lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("at") <= size)  # a line that would begin right behind adds the line end before it
    cut = F.expr(f"substring(line, 1, least(length(line), {size} - at))")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", cut.alias("line")))), lambda x: x["line"]), "\n")
    whole = begun.groupBy("doc_id").agg(F.substring(joined, 1, size).alias("sample"))
    return whole


def split_sample(paras: DataFrame, line: int = SPLIT_LINE) -> DataFrame:
    """doc_id, para and line: each paragraph's number and its first characters, with dots for the rest."""
    t = F.col("text")
    return paras.select("doc_id", "para", F.concat(F.lit("["), F.col("para").cast("string"), F.lit("] "), F.substring(t, 1, line), F.when(F.length(t) > line, "...").otherwise("")).alias("line"))
