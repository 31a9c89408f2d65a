"""Every registered query against its SQL on the smallest tables, and goldens worked out by hand."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import assembly, rows, segments
from quillstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    mine = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    theirs = sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=str)
    assert mine == theirs


def paras(spark, texts):
    return spark.createDataFrame([(1, k, t, False) for k, t in enumerate(texts, 1)], "doc_id long, para int, text string, has_img boolean")


def test_gap_runs(spark):
    marked = lambda at: spark.createDataFrame([(1, p) for p in at], "doc_id long, para int")
    got = lambda at: sorted(tuple(r)[1:3] for r in rows.gap_runs(marked(at)).collect())
    assert got([1, 2, 3, 10, 11, 20, 21, 22]) == [(1, 3), (20, 22)]
    assert got([4, 30]) == [(4, 30)]


def test_answers_go_to_the_next_section(spark):
    f = paras(spark, ["一、概念", "1．题", "【答案】A", "解", "二、练习", "【答案】B"])
    assert sorted(tuple(r)[1:] for r in rows.answer_ranges(f).collect()) == [(3, 4), (6, 6)]
    assert [r.text for r in rows.student_rows(f).orderBy("para").collect()] == ["一、概念", "1．题", "二、练习"]
    # numbers end nothing, and every kind of answer begins something
    f = paras(spark, ["一、概念", "1．甲", "【答案】A", "2．乙", "【解析】因为", "3．丙"])
    assert [tuple(r)[1:] for r in rows.answer_ranges(f).collect()] == [(3, 6)]
    f = paras(spark, ["参考答案：", "lesson 3", "甲（ 详解 ）", "考点", "【题型1】", "乙【解答】", "section"])
    assert sorted(tuple(r)[1:] for r in rows.answer_ranges(f).collect()) == [(1, 1), (3, 3), (6, 6)]


def test_questions_and_their_space(spark):
    f = paras(spark, ["说明", "1．甲", "a. 选项", "（2）乙", "填 ___ 空", "１２、丙", "证明", "一、丁", "3.戊", "（ ）"])
    assert sorted(tuple(r)[1:] for r in rows.question_spans(f).collect()) == [(2, 3), (4, 5), (6, 8), (9, 10)]
    kinds = {r.para: (r.kind, r.space) for r in rows.question_kinds(f).collect()}
    assert kinds[2] == ("choice", 0) and kinds[4] == ("blank", 0) and kinds[6] == ("short", 3) and kinds[9] == ("blank", 0)
    texts = [r.text for r in rows.answer_space(paras(spark, ["1．甲", "证明", "2．乙", "A．选项"])).orderBy("para").collect()]
    assert texts == ["1．甲", "证明", "", "", "", "2．乙", "A．选项"]


def test_numbers_go_on(spark):
    numbers = [1, 2, 5, 3, 1, 2]
    df = spark.createDataFrame([([(k, n) for k, n in enumerate(numbers, 1)],)], "x array<struct<para:int,number:int>>")
    assert df.select(segments.fold_numbers(F.col("x"), False).alias("h")).first().h == [1, 2, 4, 5, 6]


def test_red(spark):
    df = spark.createDataFrame([("FF0000",), ("640000",), ("5B0000",), ("FFFF00",), ("xyz",), (None,)], "c string")
    assert [r[0] for r in df.select(scalars.is_red(F.col("c"))).collect()] == [True, True, False, False, False, False]


def test_academic_year(spark):
    df = spark.sql("SELECT explode(array(DATE'2026-09-01', DATE'2026-08-31')) AS d")
    assert [r[0] for r in df.select(scalars.academic_year(F.col("d"))).collect()] == ["2026-2027学年", "2025-2026学年"]


def test_blank_runs_and_renumbering(spark):
    f = paras(spark, ["3．甲", "", "", "7、乙", ""])
    assert [r.para for r in rows.compress_blanks(f).orderBy("para").collect()] == [1, 3, 4, 5]
    assert [r.para for r in rows.compress_blanks(paras(spark, ["", "", "", "甲"])).orderBy("para").collect()] == [1, 3, 4]
    # only a number with a year in brackets is renumbered
    f = paras(spark, ["3．甲", "5．（2024·卷）乙", "  １２、(21-22高一)丙", "8．（1999）丁"])
    assert [r.text for r in rows.renumber(f).orderBy("para").collect()] == ["3．甲", "1．（2024·卷）乙", "  2、(21-22高一)丙", "8．（1999）丁"]


def test_practice_is_cut_at_paired_headings(spark):
    span = spark.createDataFrame([(1, 1, 40)], "doc_id long, start_para int, end_para int")
    at = lambda **texts: [r.para for r in rows.practice_boundary(paras(spark, [texts.get(f"p{k}", "甲") for k in range(1, 41)]), span).collect()]
    assert at(p25="A组", p30="B组") == [30]
    assert at(p10="基础训练", p12="能力提升") == []  # among the first twenty paragraphs
    assert at(p22="能力提升", p25="A组", p30="B组") == [30]  # a pair goes before a lone heading
    assert at(p24="B组", p22="能力提升") == [22]
    assert at(p25="基础训练 能力提升") == [25]
    blocks = spark.createDataFrame([(1, 1, "知识精讲", 1, 20), (1, 2, "即时训练", 21, 33), (1, 3, "六、巩固练习", 34, 40)], "doc_id long, ord int, marker string, start_para int, end_para int")
    f = paras(spark, ["甲"] * 24 + ["A组"] + ["甲"] * 4 + ["B组"] + ["甲"] * 10)
    assert sorted((r.ord, r.start_para, r.end_para) for r in rows.refined(blocks, f).collect()) == [(1, 1, 20), (2, 21, 29), (3, 34, 40)]
    f = paras(spark, ["甲"] * 24 + ["A组"] + ["甲"] * 11 + ["B组"] + ["甲"] * 3)
    assert sorted((r.ord, r.start_para, r.end_para) for r in rows.refined(blocks, f).collect()) == [(1, 1, 20), (2, 21, 36), (3, 37, 40)]


def test_examples_are_taken_once(spark):
    runs = spark.createDataFrame([(1, 1, 4), (1, 5, 9), (2, 1, 3)], "doc_id long, start_para int, end_para int")
    examples = spark.createDataFrame([(1, 10)], "doc_id long, para int")
    assert sorted(map(tuple, assembly.paired(runs, examples).collect())) == [(1, 1, 4, 10), (1, 5, 9, None), (2, 1, 3, None)]


def test_faulty_blocks_are_found(spark):
    blocks = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 5, 4), (1, 3, 6, 99), (2, 1, 1, 9)], "doc_id long, ord int, start_para int, end_para int")
    extents = spark.createDataFrame([(1, 1, 20), (2, 1, 9)], "doc_id long, start_para int, end_para int")
    got = {r.doc_id: tuple(r)[1:] for r in assembly.validated(blocks, extents).collect()}
    assert got == {1: (False, True, True, True), 2: (True, False, False, False)}
