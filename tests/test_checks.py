"""Messages, counters, cleaning, upload checks and likeness: goldens by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import patterns, scalars
from quillstone.operators import assembly, likeness, manifests, rows, scoring


def test_errors_of_blocks(spark):
    extents = spark.createDataFrame([(1, 1, 20), (2, 1, 9), (3, 2, 9)], "doc_id long, start_para int, end_para int")
    blocks = [(1, 1, "知识精讲", 1, 5), (1, 2, "即时训练", 5, 4), (1, 3, "六、巩固练习", 6, 99), (2, 1, "知识精讲", 1, 3), (2, 2, "即时训练", 4, 6), (2, 3, "六、巩固练习", 7, 9), (3, 1, "知识精讲", 1, 0), (4, 1, "知识精讲", 1, 2)]
    got = {r.doc_id: (r.valid, r.errors.split("\n") if r.errors else []) for r in assembly.errors(spark.createDataFrame(blocks, "doc_id long, ord int, marker string, start_para int, end_para int"), extents).collect()}
    assert got == {
        1: (False, ["即时训练 start > end：5>4", "即时训练 与上一块重叠：start=5, prev_end=5", "六、巩固练习 越界：6-99 不在 1-20"]), 2: (True, []),
        3: (False, ["blocks 数量不是 3：1", "知识精讲 start > end：1>0", "知识精讲 越界：1-0 不在 2-9"]), 4: (False, ["文档无段落"]),
    }


def test_jobs(spark):
    files = spark.createDataFrame([(1, 1, "a.docx", 5), (2, 1, "x.txt", 1), (3, 1, "b.zip", 2), (3, 2, "B.ZIP", 3), (4, 1, "c.docx", 9), (5, 1, "d.docx", 1)], "job_id long, pos int, name string, size long")
    jobs = [(k, "1v1", "smart", "auto") for k in (1, 2, 3)] + [(4, "1v1", "fast", "auto"), (5, "class", None, "auto"), (6, "1v1", "smart", "auto")]
    got = {r.job_id: r.error for r in manifests.jobs_checked(spark.createDataFrame(jobs, "job_id long, template_type string, split_mode string, docx_mode string"), files).collect()}
    assert got == {1: None, 2: "仅支持 ZIP 和 DOCX，请移除无效文件", 3: "存在同名文件，请先重命名，避免素材覆盖", 4: "不支持的生成配置", 5: "不支持的生成配置", 6: "未收到文件"}
    assert {r.job_id: tuple(r)[1:] for r in manifests.totals(files).filter("job_id IN (1, 3)").collect()} == {1: (1, 0, 1, 5), 3: (2, 2, 0, 5)}


def test_cleaning_and_counters(spark):
    texts = ["_x0007_甲_x00G7_", "\t乙\x07丙\r", "a_x000D__x000a_b", "  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.cleaned(F.col("t"))).collect()] == ["甲_x00G7_", "乙 丙", "ab", "", None]
    log = spark.createDataFrame([("RED=12 DELETED=x BLANKS=3 BLANKS=4",), ("",)], "log string")
    assert [tuple(r) for r in log.select(*(scalars.counter(F.col("log"), k) for k in ("RED", "DELETED", "BLANKS"))).collect()] == [(12, 0, 3), (0, 0, 0)]


def test_topics_know_both_kinds_of_folder(spark):
    df = spark.createDataFrame([("C:\\讲义\\导数的计算.docx",), ("a/b\\三角函数.docx",)], "n string")
    assert [r[0] for r in df.select(scalars.topic(F.col("n"))).collect()] == ["导数的计算", "三角函数"]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_likeness(spark, block):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [-1.0, -1.0]), (5, [0.0, 0.0]), (6, None)], "vec_id long, embedding array<float>")
    templates = spark.createDataFrame([(7, [3.0, 0.0]), (7, [0.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0])], "category int, template array<float>")
    got = {r.vec_id: (r.category, r.similarity) for r in likeness.best_category(vectors, templates, block).collect()}
    # of equal ones the first category; below nought counts as nought; vectors of no length are like nothing
    assert got == {1: (7, 1.0), 2: (8, 1.0), 3: (7, pytest.approx(0.707107)), 4: (7, 0.0), 5: (7, 0.0), 6: (7, 0.0)}
    assert likeness.best_category(vectors, templates.limit(0)).collect() == []


def test_likeness_is_the_cosine():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    a, b = rng.normal(size=(50, 8)), rng.normal(size=(20, 8))
    unit = b / np.linalg.norm(b, axis=1, keepdims=True)
    category, value = likeness.scored(pa.array(a.tolist(), pa.list_(pa.float64())), np.arange(20), unit)
    for k in range(50):
        want = [round(max(0.0, min(1.0, float(a[k] @ b[j] / np.linalg.norm(a[k]) / np.linalg.norm(b[j])))), 6) for j in range(20)]
        assert value[k] == pytest.approx(max(want), abs=1e-6) and category[k] == want.index(max(want))


def test_knowledge_needs_a_pattern_of_knowledge(spark):
    texts = ["定义与公式：数量", "1．（2024·卷）下列说法正确的是（  ）", "甲", "", "A. 1  B. 2", "定理：下列", "考点一 概念", "Unit 3"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    got = [tuple(r) for r in df.select(scoring.knowing(t), scoring.weight(t, patterns.KNOWLEDGE) > scoring.weight(t, patterns.QUESTION)).collect()]
    assert all(a == b for a, b in got) and {a for a, _ in got} == {True, False}


def test_types_and_weights_by_hand(spark):
    """Values that come from none of the tables of patterns."""
    want = {"考点 3 概念": "knowledge", "题型 2": "practice", "第三章 集合": "mixed", "真题·命题": "practice", "重难·点": "mixed", "01 本节·导航": "knowledge", "05 课后·三阶": "practice", "part 2": "mixed", "甲": None}
    weights = {"1．（2024·卷）下列说法正确的是（  ）": 12, "A. 1  B. 2": 6, "填 ____": 2, "乙": 0}
    df = spark.createDataFrame([(1, k, t, False) for k, t in enumerate([*want, *weights], 1)], "doc_id long, para int, text string, has_img boolean")
    got = {r.text: r for r in scoring.scored(df).collect()}
    assert {t: got[t].section_type for t in want} == want and {t: got[t].q for t in weights} == weights


def test_red_runs_near_the_threshold(spark):
    runs = [("C00000", "红"), ("640000", "红"), ("630000", "甲"), ("ff4646", "红"), ("FF4746", "乙"), ("FF4647", "丙"), ("red", "丁"), (None, "戊")]
    df = spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(runs, 1)], "doc_id long, para int, run int, colour string, text string")
    assert rows.without_red(df).first().text == "甲乙丙丁戊"
