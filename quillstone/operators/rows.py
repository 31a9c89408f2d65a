"""Windows over paragraphs and edits of them. Everything is partitioned by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching, scalars
from ..functions import patterns as P


def doc():
    return Window.partitionBy("doc_id")


def ordered():
    return doc().orderBy("para")


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def question_headers(paras: DataFrame) -> DataFrame:
    """``paras`` with ``head``, the last header of a question so far."""
    return paras.withColumn("head", F.max(F.when(F.col("text").rlike(P.QUESTION_HEADER), F.col("para"))).over(so_far()))


def question_spans(paras: DataFrame) -> DataFrame:
    """Each header of a question with the last paragraph before the next one or the end of the document."""
    f = question_headers(paras).filter("head IS NOT NULL")
    return f.groupBy("doc_id", F.col("head").alias("start_para")).agg(F.max("para").alias("end_para"))


def question_kinds(paras: DataFrame) -> DataFrame:
    """choice, blank or short for each question, by the paragraphs of its span, and the rows of answer space that it gets."""
    t = F.col("text")
    kind = F.when(F.bool_or(t.rlike(P.CHOICE_LINE)), "choice").when(F.bool_or(t.rlike(P.BLANK_SPACE)), "blank").otherwise("short")
    f = question_headers(paras).filter("head IS NOT NULL")
    found = f.groupBy("doc_id", F.col("head").alias("para")).agg(kind.alias("kind"), F.max("para").alias("end_para"))
    # a numbered part is a header of its own, so that a span never has more than one
    return found.withColumn("space", F.when(F.col("kind") == "short", 3).otherwise(0))


def answer_space(paras: DataFrame) -> DataFrame:
    """``paras`` (doc_id, para, text) with empty rows behind questions that have neither options nor blanks, counted anew."""
    spaces = question_kinds(paras).filter("space > 0").select("doc_id", F.col("end_para").alias("para"), F.explode(F.expr("sequence(1, space)")).alias("extra"), F.lit("").alias("text"))
    every = paras.select("doc_id", "para", F.lit(0).alias("extra"), "text").unionByName(spaces)
    return every.select("doc_id", F.row_number().over(doc().orderBy("para", "extra")).alias("para"), "text")


def compress_blanks(paras: DataFrame) -> DataFrame:
    """One empty paragraph of each run stays, the last; a document's first paragraph always does."""
    f = paras.withColumns({"following": F.lead("text").over(ordered()), "first": F.min("para").over(doc())})
    return f.filter(~((F.col("text") == "") & F.coalesce(F.col("following") == "", F.lit(False)) & (F.col("para") > F.col("first")))).drop("following", "first")


def renumber(paras: DataFrame) -> DataFrame:
    """Exam questions (a number and a year in brackets) get the numbers from 1 in order."""
    asked = F.col("text").rlike(P.EXAM_QUESTION)
    at = F.row_number().over(Window.partitionBy("doc_id", asked).orderBy("para"))
    text = F.when(asked, F.regexp_replace("text", r"^(\s*)\p{Nd}{1,3}", F.concat(F.lit("$1"), F.col("at").cast("string")))).otherwise(F.col("text"))
    return paras.withColumn("at", at).select("doc_id", "para", text.alias("text"))


def position_ratio(paras: DataFrame) -> DataFrame:
    return paras.select("doc_id", "para", F.round(F.percent_rank().over(ordered()), 9).alias("ratio"))


def gap_runs(marked: DataFrame, gap: int = 3, least: int = 3) -> DataFrame:
    """Runs of marked paragraphs no further apart than ``gap``, of ``least`` members; documents with fewer have one run."""
    f = marked.withColumn("total", F.count("*").over(doc())).withColumn("new", F.coalesce((F.col("para") - F.lag("para").over(ordered()) > gap) & (F.col("total") >= least), F.lit(False)))
    f = f.withColumn("run", F.sum(F.col("new").cast("int")).over(so_far()))
    runs = f.groupBy("doc_id", "run").agg(F.min("para").alias("start_para"), F.max("para").alias("end_para"), F.count("*").alias("n"), F.first("total").alias("total"))
    return runs.filter((F.col("n") >= least) | (F.col("total") < least)).select("doc_id", "start_para", "end_para", "n")


def answer_ranges(paras: DataFrame) -> DataFrame:
    """What answers take with them: from the marker to before the next section or topic; ranges that meet are one."""
    f = _answers(paras).filter("gone")
    f = f.withColumn("run", F.col("para") - F.row_number().over(ordered()))
    return f.groupBy("doc_id", "run").agg(F.min("para").alias("start_para"), F.max("para").alias("end_para")).drop("run")


def _answers(paras: DataFrame) -> DataFrame:
    t = F.col("text")
    last = lambda pattern: F.max(F.when(t.rlike(pattern), F.col("para"))).over(so_far())
    return paras.withColumns({"marker": last(P.ANSWER), "head": last(P.ANSWER_ENDS)}).withColumn("gone", F.col("marker").isNotNull() & (F.coalesce("head", F.lit(0)) <= F.col("marker")))


def student_rows(paras: DataFrame) -> DataFrame:
    """A document without its answers: blanks are compressed, paragraphs counted anew."""
    kept = compress_blanks(_answers(paras).filter("NOT gone").select("doc_id", "para", "text"))
    return kept.select("doc_id", F.row_number().over(ordered()).alias("para"), "text")


#: Paragraphs at the beginning of a document that may be its table of contents.
CONTENTS_END = 20


def practice_headings(paras: DataFrame) -> DataFrame:
    """doc_id and said (para, pair, basic, advanced): the headings of PRACTICE_PAIRS behind the contents, a row for each document that has any."""
    each = F.array(*(F.struct("para", F.lit(k).alias("pair"), F.col("text").contains(b).alias("basic"), F.col("text").contains(a).alias("advanced")) for k, (b, a) in enumerate(P.PRACTICE_PAIRS)))
    # few paragraphs have any of the headings, so that which ones they have is only looked at in those
    words = {"_any": matching.alternation([w for pair in P.PRACTICE_PAIRS for w in pair])}
    f = matching.with_tried(paras.filter(F.col("para") > CONTENTS_END).select("doc_id", "para", "text"), words).filter("_any")
    return f.groupBy("doc_id").agg(F.flatten(F.collect_list(F.filter(each, lambda x: x["basic"] | x["advanced"]))).alias("said"))


def first_advanced(said: Column, start: Column, end: Column) -> Column:
    """Where advanced practice begins among the headings between ``start`` and ``end``; one pass over them for each pair."""
    inside = F.filter(said, lambda x: x["para"].between(start, end))
    place = lambda c: F.array_min(F.transform(c, lambda x: x["para"]))

    def paired(k: int) -> Column:
        since = place(F.filter(inside, lambda x: (x["pair"] == k) & x["basic"]))
        return place(F.filter(inside, lambda x: (x["pair"] == k) & x["advanced"] & (x["para"] >= since)))

    return F.coalesce(*(paired(k) for k in range(len(P.PRACTICE_PAIRS))), place(F.filter(inside, lambda x: x["advanced"])))


def practice_boundary(paras: DataFrame, spans: DataFrame) -> DataFrame:
    """Where advanced practice begins within the practice of each document (spans: doc_id, start_para, end_para).

    The first pair of headings, in the order of the pairs, of which the basic one occurs and then, or in the same
    paragraph, the advanced one; where there is none, the first paragraph with any advanced heading.
    """
    f = practice_headings(paras).join(spans, "doc_id")
    return f.select("doc_id", F.explode(F.array(first_advanced(F.col("said"), F.col("start_para"), F.col("end_para")))).alias("para")).filter("para IS NOT NULL")


def refined(blocks: DataFrame, paras: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, ord, marker, start_para, end_para) with drill and consolidation cut at the practice boundary.

    Only a boundary strictly inside the practice moves anything; a consolidation block that begins at or behind it stays.
    A document of fewer than two blocks stays as it is. Blocks are gathered by document, so that what makes them runs once.
    """
    drill, later = F.col("marker") == P.MARKER_DRILL, F.col("marker").isin(P.MARKER_CONSOLIDATION, P.CLASS_CONSOLIDATION)
    filled = F.col("start_para") <= F.col("end_para")
    practice = (drill | later) & filled
    own = [c for c in blocks.columns if c != "doc_id"]
    d = blocks.groupBy("doc_id").agg(F.min_by("start_para", F.when(practice, F.col("ord"))).alias("_since"), F.max(F.when(practice, F.col("end_para"))).alias("_to"), F.count("*").alias("_n"), F.collect_list(F.struct(*own)).alias("_rows"))
    d = d.join(practice_headings(paras), "doc_id", "left")
    at = F.when((F.col("_n") >= 2) & F.col("said").isNotNull(), first_advanced(F.col("said"), F.col("_since"), F.col("_to")))
    d = d.select("doc_id", "_since", "_to", F.explode_outer(F.array(at)).alias("_at"), "_rows").select("doc_id", F.when((F.col("_since") < F.col("_at")) & (F.col("_at") < F.col("_to")), F.col("_at")).alias("_cut"), F.explode_outer("_rows").alias("_row")).select("doc_id", "_cut", "_row.*")
    cut = F.col("_cut")
    start = F.when(later & filled & (cut > F.col("start_para")), cut).otherwise(F.col("start_para"))
    end = F.when(drill & filled & cut.isNotNull(), cut - 1).otherwise(F.col("end_para"))
    return d.withColumns({"s": start, "e": end}).select(*(F.col({"start_para": "s", "end_para": "e"}.get(c, c)).alias(c) for c in blocks.columns))


def without_red(runs: DataFrame) -> DataFrame:
    """The paragraphs (doc_id, para, text) of runs (doc_id, para, run, colour, text) without the text of red ones."""
    text = F.when(scalars.is_red(F.col("colour")), "").otherwise(F.coalesce("text", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", text.alias("text")))), lambda r: r["text"]), "")
    return runs.groupBy("doc_id", "para").agg(F.trim(joined).alias("text"))


def student_version(runs: DataFrame) -> DataFrame:
    """A document's runs without red text and answers, with space for the answers that are asked for."""
    return answer_space(student_rows(without_red(runs)))


def extent(paras: DataFrame) -> DataFrame:
    """The one block that the whole of a document makes."""
    return paras.groupBy("doc_id").agg(F.min("para").alias("start_para"), F.max("para").alias("end_para"), F.count("*").alias("n_paras"))
