"""Candidates for where practice and consolidation begin, the choice among them, and whether it wants a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P
from ..functions import scalars
from .assembly import faults
from .segments import block, fold_numbers, ordered, share

CANDIDATE = "array<struct<kind:string,para:int,score:int,reason:string,text:string,source:string,seq:int>>"
PRACTICE, CONSOLIDATION = "practice_start", "consolidation_start"

# The reasons of candidates and of reviews, which are output.
SECTION_04, SECTION_05 = "学科网 04 练习章节", "学科网 05 课后三阶/巩固章节"
PRACTICE_WORD, CONSOLIDATION_WORD, READING = "练习标记：", "巩固标记：", "阅读理解/真题再现起点"
DENSE_STRONG, DENSE_LATE, DENSE_EARLY = "连续编号题且有年份/选项/填空特征", "文档中后段出现连续编号题", "较早出现连续编号题，可能是知识编号，低置信"
BY_COUNT, BY_SHARE = "未发现明确巩固标记，按题目数量 70% 兜底", "未发现明确巩固标记，按段落比例 70% 兜底"
NO_PRACTICE, NO_CONSOLIDATION = "缺少即时训练候选", "缺少巩固练习候选"
PRACTICE_UNSURE, CONSOLIDATION_UNSURE = "即时训练候选置信度偏低：", "巩固练习候选置信度偏低："
REPORT_CANDIDATES, REPORT_CHOICE, REPORT_BLOCKS, RULE = "候选边界", "最终选择", "生成 blocks", "-" * 50
TITLES = {"practice_start": ("即时训练候选", "即时训练开始"), "consolidation_start": ("巩固练习候选", "巩固练习开始")}
NONE, NOT_FOUND, VALID, INVALID = "  （无）", ": 未找到明确候选", "合法性: 通过", "合法性: 失败"
SEVERAL_PRACTICES, SEVERAL_CONSOLIDATIONS, CLEAR = "即时训练存在多个高分候选", "巩固练习存在多个高分候选", "离线候选足够明确"


def first_word(text: Column, words: list[str]) -> Column:
    """The first of ``words``, in their order, that the text contains."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def candidate(when: Column, kind: str, score: Column | int, reason: Column | str, source: str, seq: int) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.col("para"), lit(score).alias("score"), lit(reason).alias("reason"), scalars.short(F.col("text"), 80).alias("text"), F.lit(source).alias("source"), F.lit(seq).alias("seq")))


def of_row() -> Column:
    """What a paragraph says by itself; headings that belong to a table of contents and dotted lines say nothing."""
    t, section = F.col("text"), F.regexp_extract("text", P.COURSE_SECTION, 1)
    practice, consolidation = first_word(t, P.PRACTICE_WORDS), first_word(t, P.CONSOLIDATION_WORDS)
    said = F.array(
        candidate(section == "04", PRACTICE, 96, SECTION_04, "toc", 1),
        candidate(section == "05", CONSOLIDATION, 98, SECTION_05, "toc", 2),
        candidate(practice.isNotNull(), PRACTICE, F.when(practice.isin(P.STRONG_PRACTICE_WORDS), 97).otherwise(90), F.concat(F.lit(PRACTICE_WORD), practice), "marker", 3),
        candidate(consolidation.isNotNull(), CONSOLIDATION, F.when(consolidation.isin(P.STRONG_CONSOLIDATION_WORDS), 98).otherwise(91), F.concat(F.lit(CONSOLIDATION_WORD), consolidation), "marker", 4),
        candidate(t.rlike(P.READING_START), PRACTICE, 88, READING, "reading", 5),
    )
    near = lambda lo, hi, no: F.coalesce(F.max(F.regexp_extract("text", P.COURSE_SECTION, 1) == no).over(ordered().rangeBetween(lo, hi)), F.lit(False))
    listed = ((section == "04") & near(1, 2, "05")) | ((section == "05") & near(-2, -1, "04"))
    return F.when(listed | (t == "") | t.rlike(P.DOTTED), F.array().cast(CANDIDATE)).otherwise(F.array_compact(said))


def dense(first: Column, last: Column, numbered: Column, hits: Column, near: int = 18) -> Column:
    """The first three questions in a row within ``near`` paragraphs, as a candidate."""
    at = F.get(F.filter(hits, lambda p, i: F.get(hits, i + 2) - p <= near), F.lit(0))
    row = F.get(F.filter(numbered, lambda x: x["para"] == at), F.lit(0))
    strong = row["strong"]
    late = (at - first) / F.greatest(last - first, F.lit(1)) >= 0.25
    score, reason = F.when(strong, 86).when(late, 74).otherwise(62), F.when(strong, DENSE_STRONG).when(late, DENSE_LATE).otherwise(DENSE_EARLY)
    return F.when(at.isNotNull(), F.struct(F.lit(PRACTICE).alias("kind"), at.alias("para"), score.alias("score"), reason.alias("reason"), row["head"].alias("text"), F.lit("question_density").alias("source"), F.lit(6).alias("seq")))


def collected(paras: DataFrame) -> DataFrame:
    """doc_id, first, last, hits (questions that go on from one another) and said (all candidates), a row for each document."""
    t = F.col("text")
    number = F.regexp_extract(t, P.NUMBER + r"\s*\S", 1)
    option_near = F.coalesce(F.max(t.rlike(P.OPTION)).over(ordered().rangeBetween(1, 5)), F.lit(False))
    f = paras.withColumns({"said": of_row(), "strong": t.rlike(P.YEAR_TAG) | t.rlike(P.BLANK) | option_near})
    d = f.groupBy("doc_id").agg(
        F.min("para").alias("first"), F.max("para").alias("last"), F.flatten(F.collect_list("said")).cast(CANDIDATE).alias("said"),
        F.array_sort(F.collect_list(F.when(number != "", F.struct("para", scalars.number(number).alias("number"), "strong", scalars.short(t, 80).alias("head"))))).alias("numbered"),
    )
    d = d.withColumn("hits", fold_numbers(F.col("numbered"), False))
    with_dense = F.array_compact(F.array_append("said", dense(F.col("first"), F.col("last"), F.col("numbered"), F.col("hits")))).cast(CANDIDATE)
    return d.select("doc_id", "first", "last", "hits", with_dense.alias("said"))


def each(found: DataFrame) -> DataFrame:
    """doc_id and c, a row for each candidate.

    Outer, with a filter behind it: that of an inner explosion would go down the plan and find all candidates once more for it.
    """
    return found.select("doc_id", F.explode_outer("said").alias("c")).filter("c IS NOT NULL")


def merged(found: DataFrame) -> DataFrame:
    """A row for each kind and paragraph: the best score with its source, and all reasons once, in order of arrival."""
    return _merged(each(found).select("doc_id", "c.*"))


def _merged(c: DataFrame, *more: Column) -> DataFrame:
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]))
    return c.groupBy("doc_id", "kind", "para").agg(F.max("score").alias("score"), F.max_by("text", F.struct("score", -F.col("seq"))).alias("text"), F.max_by("source", F.struct("score", -F.col("seq"))).alias("source"), F.array_join(reasons, "；").alias("reason"), *more)


def chosen(found: DataFrame) -> DataFrame:
    """``found`` with practice and consolidation (structs of para, score and source; null if none) and the best two of each kind."""
    ranked = lambda kind: F.array_sort(F.transform(F.filter("said", lambda c: c["kind"] == kind), lambda c: F.struct((-c["score"]).alias("less"), c["para"].alias("para"), c["seq"].alias("seq"), c["source"].alias("source"))))
    pick = lambda c: F.when(c.isNotNull(), F.struct(c["para"].alias("para"), (-c["less"]).alias("score"), c["source"].alias("source")))
    f = found.withColumns({"practices": ranked(PRACTICE), "consolidations": ranked(CONSOLIDATION)})
    f = f.withColumn("practice", pick(F.get("practices", F.lit(0))))
    p, last = F.col("practice.para"), F.col("last")
    later = F.filter("hits", lambda x: x >= p)
    by_question = F.when((F.size(later) >= 4) & (share(later) < F.size(later)), F.get(later, share(later)))
    by_share = F.greatest(p + 1, F.least(p + ((last - p) * F.lit(0.7)).cast("int"), last))
    fallback = F.when(p.isNotNull(), F.struct(F.coalesce(by_question, by_share).alias("para"), F.when(by_question.isNotNull(), 55).otherwise(45).alias("score"), F.lit("fallback").alias("source")))
    after = pick(F.get(F.filter("consolidations", lambda c: c["para"] > p), F.lit(0)))
    return f.withColumn("consolidation", F.coalesce(after, fallback))


def choice(found: DataFrame) -> DataFrame:
    c = chosen(found).filter("practice IS NOT NULL")
    return c.select("doc_id", *(F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in ("practice", "consolidation") for x in ("para", "score", "source")))


def candidate_blocks(found: DataFrame) -> DataFrame:
    """The three blocks that follow from the choice: without one, practice begins in the middle."""
    return built(found).select("doc_id", F.explode_outer("made").alias("b")).select("doc_id", "b.*")


def built(found: DataFrame) -> DataFrame:
    """``chosen`` with made, an array of those blocks."""
    first, last = F.col("first"), F.col("last")
    f = chosen(found).withColumn("p0", F.coalesce("practice.para", first + ((last - first) * F.lit(0.5)).cast("int")))
    f = f.withColumn("c0", F.coalesce("consolidation.para", F.col("p0") + ((last - F.col("p0")) * F.lit(0.7)).cast("int")))
    f = f.withColumn("p", F.greatest(first, F.least("p0", "last")))
    f = f.withColumn("c", F.when(F.col("p") < last, F.greatest(F.col("p") + 1, F.least("c0", "last"))).otherwise(last))
    made = F.array(
        block(1, P.MARKER_KNOWLEDGE, first, F.greatest(first, F.col("p") - 1)), block(2, P.MARKER_DRILL, F.col("p"), F.greatest(F.col("p"), F.col("c") - 1)), block(3, P.MARKER_CONSOLIDATION, F.col("c"), last)
    )
    return f.withColumn("made", made)


def review(found: DataFrame) -> DataFrame:
    """doc_id, whether the choice wants a review, and the first reason that holds."""

    def close(name):
        best = F.get(name, F.lit(0))
        second = F.get(F.filter(name, lambda c: c["para"] != best["para"]), F.lit(0))
        return F.coalesce((second["less"] - best["less"] <= 5) & (F.abs(second["para"] - best["para"]) >= 20), F.lit(False))

    why = (
        F.when(F.col("practice").isNull(), NO_PRACTICE).when(F.col("consolidation").isNull(), NO_CONSOLIDATION)
        .when(F.col("practice.score") < 80, F.concat(F.lit(PRACTICE_UNSURE), F.col("practice.score").cast("string"))).when(F.col("consolidation.score") < 80, F.concat(F.lit(CONSOLIDATION_UNSURE), F.col("consolidation.score").cast("string")))
        .when(close("practices"), SEVERAL_PRACTICES).when(close("consolidations"), SEVERAL_CONSOLIDATIONS).otherwise(CLEAR)
    )
    # a fallback never scores 80, so that its source needs no test of its own
    return chosen(found).select("doc_id", (why != CLEAR).alias("wanted"), why.alias("reason"))


def candidate_line() -> Column:
    return F.concat(F.lit("  ["), F.lpad(F.col("score").cast("string"), 3, " "), F.lit("] 段落 "), F.col("para").cast("string"), F.lit(": "), F.col("reason"), F.lit(" | "), F.col("text"))


def report(found: DataFrame, top: int = 6) -> DataFrame:
    """A line for each of the ``top`` best candidates of a document and kind, in their order, as reports print them."""
    w = Window.partitionBy("doc_id", "kind").orderBy(F.desc("score"), "para")
    best = merged(found).withColumn("at", F.row_number().over(w)).filter(F.col("at") <= top)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", candidate_line().alias("line")))), lambda x: x["line"]), "\n")
    return best.groupBy("doc_id", "kind").agg(lines.alias("lines"))


def full_report(found: DataFrame, top: int = 6) -> DataFrame:
    """doc_id and report: the best candidates, the choice, its blocks and what is wrong with them, as one text for each document."""
    # a document's choice and blocks go along with its candidates, so that what finds them runs once
    of = F.struct("first", "last", "made", *(F.col(f"{n}.{x}").alias(f"{n}_{x}") for n in ("practice", "consolidation") for x in ("para", "score", "source")))
    each = built(found).select("doc_id", of.alias("of"), F.explode_outer("said").alias("c")).select("doc_id", "of", "c.*")
    at = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.desc("score"), "para"))
    c = _merged(each, F.first("of").alias("of")).withColumn("at", at)
    own = lambda kind, name: F.max(F.when((F.col("kind") == kind) & (F.col("para") == F.col(f"of.{name}_para")), F.col("reason"))).alias(f"{name}_reason")
    best = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("at") <= top), F.struct("at", candidate_line().alias("line"))))), lambda x: x["line"]), "\n")
    d = c.groupBy("doc_id").agg(F.first("of").alias("of"), *(F.nullif(best(k), F.lit("")).alias(f"{k}_lines") for k in TITLES), own(PRACTICE, "practice"), own(CONSOLIDATION, "consolidation")).select("*", "of.*")
    fallback = F.when(F.col("consolidation_score") == 55, BY_COUNT).otherwise(BY_SHARE)
    reason = {"practice": F.col("practice_reason"), "consolidation": F.when(F.col("consolidation_source") == "fallback", fallback).otherwise(F.col("consolidation_reason"))}
    line = lambda b: F.concat(F.lit("  "), b["marker"], F.lit(": "), b["start_para"].cast("string"), F.lit("-"), b["end_para"].cast("string"))
    wrong = F.flatten(F.transform("made", lambda b, i: F.array_compact(F.array(*faults(b, F.when(i > 0, F.get("made", i - 1)["end_para"]), F.col("first"), F.col("last"))))))
    d = d.withColumns({"blocks": F.array_join(F.transform("made", line), "\n"), "valid": F.size(wrong) == 0, "errors": F.array_join(wrong, "\n")})
    pick = lambda kind, name: F.concat(F.lit(TITLES[kind][1]), F.when(F.col(f"{name}_para").isNull(), NOT_FOUND).otherwise(F.concat(F.lit(": 段落 "), F.col(f"{name}_para").cast("string"), F.lit("，"), reason[name], F.lit("，置信度 "), F.col(f"{name}_score").cast("string"))))
    listed = [x for k, (title, _) in TITLES.items() for x in (F.lit(title), F.coalesce(f"{k}_lines", F.lit(NONE)))]
    verdict = F.when(F.col("valid"), VALID).otherwise(F.concat(F.lit(INVALID + "\n  - "), F.replace(F.col("errors"), F.lit("\n"), F.lit("\n  - "))))
    parts = [F.lit(REPORT_CANDIDATES), F.lit(RULE), *listed, F.lit(""), F.lit(REPORT_CHOICE), F.lit(RULE), pick(PRACTICE, "practice"), pick(CONSOLIDATION, "consolidation"), F.lit(""), F.lit(REPORT_BLOCKS), F.lit(RULE), F.col("blocks"), verdict]
    return d.select("doc_id", F.concat_ws("\n", *parts).alias("report"))
