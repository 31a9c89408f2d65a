"""Filling of templates, relations, replies, samples and version plans: goldens by hand."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import candidates, contents, filling, relations, replies, rows, tiers, versions

BLOCK = "doc_id long, ord int, marker string, start_para int, end_para int"


def paras(spark, texts, doc_id=1):
    return spark.createDataFrame([(doc_id, k, t, False) for k, t in enumerate(texts, 1)], "doc_id long, para int, text string, has_img boolean")


def test_blocks_cut_no_table(spark):
    spans = spark.createDataFrame([(1, 3, 6), (1, 5, 8), (1, 4, 4), (1, 9, 10), (1, 20, 22), (2, 1, 2)], "doc_id long, start_para int, end_para int")
    assert sorted(tuple(r) for r in filling.table_islands(spans).collect()) == [(1, 3, 8), (1, 9, 10), (1, 20, 22), (2, 1, 2)]
    blocks = [(1, 1, "k", 1, 4), (1, 2, "d", 5, 8), (1, 3, "c", 10, 21), (2, 1, "k", 1, 0), (2, 2, "d", 2, 3), (3, 1, "k", 1, 9)]
    got = filling.widened(spark.createDataFrame(blocks, BLOCK), spans).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, "k", 1, 8), (1, 2, "d", 3, 8), (1, 3, "c", 9, 22), (2, 1, "k", 1, 0), (2, 2, "d", 1, 3), (3, 1, "k", 1, 9)]


TEMPLATE = ["讲义", "", "", "知识精讲&例题讲解", "知识精讲", "", "", "即时训练（一）", "即时训练", "五、归纳总结"]
MARKERS = ["知识精讲", "即时训练", "六、巩固练习", "知识精讲&例题讲解"]


@pytest.fixture(scope="module")
def template(spark):
    frame = spark.createDataFrame([("t", k, x) for k, x in enumerate(TEMPLATE, 1)], "template string, pos int, text string")
    markers = spark.createDataFrame([("t", k, m) for k, m in enumerate(MARKERS, 1)], "template string, rank int, marker string")
    return frame, filling.anchors(frame, markers)


def test_anchors_are_first_rows_that_begin_with_a_marker(template):
    # the first row begins with both names of knowledge, and the one of lower rank takes it; the longer one finds no other
    assert sorted((r.marker, r.at) for r in template[1].collect()) == [("即时训练", 8), ("知识精讲", 4)]


def test_filled_rows(spark, template):
    frame, found = template
    blocks = spark.createDataFrame([(1, "t", 1, "知识精讲", 1, 2), (1, "t", 2, "即时训练", 3, 4), (1, "t", 3, "六、巩固练习", 5, 5), (2, "t", 1, "知识精讲", 1, 0), (3, "t", 1, "即时训练", 1, 1), (3, "t", 2, "即时训练", 2, 2)], "doc_id long, template string, ord int, marker string, start_para int, end_para int")
    source = paras(spark, ["甲", "", "乙", "丙", "丁"]).unionByName(paras(spark, ["子", "丑"], 3))
    got = filling.filled_rows(source, blocks, frame, found)
    texts = {d: [r.text for r in got.filter(F.col("doc_id") == d).orderBy("pos").collect()] for d in (1, 2, 3)}
    assert texts[1] == [*TEMPLATE[:4], "甲", "", *TEMPLATE[4:8], "乙", "丙", *TEMPLATE[8:]]
    assert texts[2] == TEMPLATE
    assert texts[3] == [*TEMPLATE[:8], "丑", "子", *TEMPLATE[8:]]  # of one anchor, what is pasted last stands first
    assert [tuple(r) for r in filling.missing_anchors(blocks, found).collect()] == [(1, 3, "六、巩固练习")]
    trimmed = [r.text for r in filling.trimmed(got).filter("doc_id = 1").orderBy("pos").collect()]
    assert trimmed == [*TEMPLATE[:4], "甲", "", "知识精讲", "", "即时训练（一）", "乙", "丙", *TEMPLATE[8:]]


def test_relations(spark):
    own = spark.createDataFrame([("p", "rId1", "image", "a"), ("p", "rId3", "image", "b"), ("p", "rId4", "ole", "a"), ("p", "x7", "image", "c"), ("p", "rId9", "image", "b")], "package string, rid string, kind string, target string")
    uses = [("p", 1, 1, "rId5", "image", "b"), ("p", 1, 2, "rId6", "image", "new"), ("p", 1, 3, "rId7", "ole", "new"), ("p", 2, 1, "rId1", "image", "new"), ("p", 2, 2, "rId2", "image", "c"), ("p", 2, 3, "rId3", "image", "z"), ("p", 2, 3, "rId3", "image", "z"), ("q", 1, 1, "rId8", "image", "a")]
    got = relations.migrated(own, spark.createDataFrame(uses, "package string, source int, nth int, rid string, kind string, target string"))
    assert {tuple(r)[:3]: r.new_rid for r in got.collect()} == {
        ("p", 1, "rId5"): "rId3", ("p", 1, "rId6"): "rId2", ("p", 1, "rId7"): "rId5", ("p", 2, "rId1"): "rId2", ("p", 2, "rId2"): "x7", ("p", 2, "rId3"): "rId6", ("q", 1, "rId8"): "rId1",
    }
    xml = '<a:blip r:embed="rId1" r:link="rId2"/><v r:id="rId2">rId1 "x"</v><b r:id="rId9"/><w:t id="rId1"/>'
    df = spark.createDataFrame([(xml, {"rId1": "rId2", "rId2": "rId1"})], "xml string, ids map<string,string>")
    assert df.select(relations.rewritten(F.col("xml"), F.col("ids"))).first()[0] == '<a:blip r:embed="rId2" r:link="rId1"/><v r:id="rId1">rId1 "x"</v><b r:id="rId9"/><w:t id="rId1"/>'


def test_replies_as_json(spark):
    texts = ['x {"practice_start": 3, "consolidation_start": "7", "reason": " r "} y', '{"practice_start": 3}', '{"practice_start": ', "none", None, '{"a": {"practice_start": 1}}', '{"practice_start": 1.5, "consolidation_start": 9}', '{"practice_start": 2, "consolidation_start": 5} {']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, reply string")
    assert sorted(tuple(r) for r in replies.reviews(df).collect()) == [(0, 3, 7, "r"), (1, 3, None, ""), (5, None, None, ""), (6, None, 9, ""), (7, 2, 5, "")]
    text = "【教学目标】 ①甲\n②乙 【重点难点】\n重点：丙"
    parts = spark.createDataFrame([(text,)], "t string").select(replies.between(F.col("t"), "【教学目标】", "【"), replies.between(F.col("t"), "【重点难点】"), replies.between(F.col("t"), "【无】")).first()
    assert tuple(parts) == ("①甲\n②乙", "重点：丙", "")


def test_reply_blocks(spark):
    texts = [
        '{"blocks": [{"type": "knowledge", "start_para": 1}, {"type": "practice", "start_para": 4}, {"type": "consolidation", "start_para": 8}]}', '{"blocks": [{"type": "practice", "start_para": 6}, {"type": "knowledge", "start_para": 1}]}',
        '{"blocks": [{"type": "practice", "start_para": 6}]}', '{"blocks": [{"type": "other", "start_para": 3}, {"type": "practice", "start_para": 5}]}', '{"blocks": 7}', '{"blocks": [{"type": "knowledge", "start_para": 0}, {"type": "practice", "start_para": 5}]}',
    ]
    extents = spark.createDataFrame([(k, 1, 10) for k in range(6)], "doc_id long, start_para int, end_para int")
    got = sorted((r.doc_id, r.ord, r.start_para, r.end_para) for r in replies.reply_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, reply string"), extents).collect())
    assert got == [(0, 1, 1, 3), (0, 2, 4, 7), (0, 3, 8, 10), (1, 1, 1, 5), (1, 2, 6, 10), (3, 2, 5, 10)]


def test_coverage(spark):
    df = spark.createDataFrame([([[0, 2], [1, 1, 9, -1]], 3), ([[0]], 2), ([[]], 0)], "i array<array<int>>, n int")
    assert [r[0] for r in df.select(replies.covers(F.col("i"), F.col("n"))).collect()] == [True, False, True]


def test_samples(spark):
    f = paras(spark, [" 甲 ", "", "乙" * 200] + ["丙" * 99] * 160)
    got = replies.objectives_sample(f).first().sample
    lines = ["甲", "乙" * 100] + ["丙" * 99] * 147
    assert got == "\n".join(lines)[:3000] and len(got) == 3000
    assert replies.objectives_sample(paras(spark, ["甲", "", " 乙"])).first().sample == "甲\n乙"
    assert replies.objectives_sample(paras(spark, ["", " "])).collect() == []
    exact = paras(spark, ["丙" * 99] * 29 + ["丁" * 99, "戊" * 99])
    assert replies.objectives_sample(exact).first().sample == "\n".join(["丙" * 99] * 29 + ["丁" * 99, ""])[:3000]
    assert [r.line for r in replies.split_sample(paras(spark, ["甲" * 151, "乙"])).orderBy("para").collect()] == [f"[1] {'甲' * 150}...", "[2] 乙"]


def test_reviews_may_name_candidates_alone(spark):
    texts = ["甲"] * 9 + ["基础训练"] + ["甲"] * 9 + ["能力提升"] + ["甲"] * 30
    f = spark.createDataFrame([(d, k, t, False) for d in range(6) for k, t in enumerate(texts, 1)], "doc_id long, para int, text string, has_img boolean")
    found = candidates.collected(f)
    said = ['{"practice_start": 10, "consolidation_start": 20}', '{"practice_start": 20, "consolidation_start": 10}', '{"practice_start": 11, "consolidation_start": 20}', '{"practice_start": 10}', "?"]
    got = replies.reviewed_blocks(found, spark.createDataFrame(list(enumerate(said)), "doc_id long, reply string"))
    assert {r.doc_id: r.source for r in got.collect()} == {0: "review", **{k: "offline" for k in range(1, 6)}}
    assert sorted((r.ord, r.start_para, r.end_para) for r in got.filter("doc_id = 0").collect()) == [(1, 1, 9), (2, 10, 19), (3, 20, 50)]
    sample = sorted(r.para for r in replies.review_sample(f.filter("doc_id = 0"), found.filter("doc_id = 0")).collect())
    assert sample == list(range(1, 31))  # ten around 10 and 20, each once


def test_contents_come_before_other_tiers(spark):
    listed = ["目录", "知识梳理........ 1", "基础训练...... 5", "能力提升..... 9", ""]
    body = ["知识梳理", *["甲"] * 20, "基础训练", *["乙"] * 5, "能力·提升", *["丙"] * 3]
    named = paras(spark, [*listed, *body]).unionByName(paras(spark, ["【题型1 甲】", "乙", "丙"], 2)).unionByName(paras(spark, ["甲", "乙", "丙", "丁"], 3))
    got = {(r.doc_id, r.ord): (r.tier, r.start_para, r.end_para) for r in contents.smart_split(named).collect()}
    # its letters are looked for, whatever stands between them
    assert got[1, 1] == ("toc", 1, 26) and got[1, 2] == ("toc", 27, 32) and got[1, 3] == ("toc", 33, 36)
    assert got[2, 1][0] == "type" and got[3, 1][0] == "proportional"
    assert {r.tier for r in contents.smart_split(named, hybrid_first=True).collect()} == {"hybrid"}
    blocks = tiers.first_tier(contents.smart_split(named))
    assert sorted(tuple(r) for r in rows.refined(blocks, named).collect()) == sorted(tuple(r) for r in contents.smart_blocks(named).collect())


def test_refinement_leaves_single_blocks_alone(spark):
    f = paras(spark, ["甲"] * 24 + ["A组"] + ["甲"] * 4 + ["B组"] + ["甲"] * 10)
    one = spark.createDataFrame([(1, 1, "即时训练", 1, 40)], BLOCK)
    assert [tuple(r) for r in rows.refined(one, f).collect()] == [(1, 1, "即时训练", 1, 40)]


def test_versions_fail_alone(spark):
    f = paras(spark, ["甲"] * 9 + ["基础训练"] + ["甲"] * 9 + ["能力提升"] + ["甲"] * 30)
    plan = spark.createDataFrame([(1, 1, "full"), (2, 1, "candidate"), (3, 1, "smart"), (4, 9, "smart"), (5, 1, "huge"), (6, 1, "ideal"), (7, 1, None), (8, 1, "full")], "version_id long, doc_id long, mode string")
    got = {}
    for r in versions.version_blocks(plan, f).collect():
        got.setdefault((r.version_id, r.status), []).append((r.ord, r.start_para, r.end_para))
    got = {k: sorted(v, key=str) for k, v in got.items()}
    three = [(1, 1, 9), (2, 10, 19), (3, 20, 50)]
    none = [(None, None, None)]
    assert got == {(1, "ok"): [(1, 1, 50)], (2, "ok"): three, (3, "ok"): three, (4, "no source"): none, (5, "no such mode"): none, (6, "ok"): three, (7, "no such mode"): none, (8, "ok"): [(1, 1, 50)]}


FIELDS = "doc_id long, subject string, grade string, topic string, handout_type string, objectives string, difficulties string"


def test_covers(spark):
    fields = spark.createDataFrame([(1, "物理", None, "力", "讲义", "目标 五年级", ""), (2, "", "高一", "集合", None, None, "难")], FIELDS)
    got = {(r.doc_id, r.row, r.col): r.text for r in filling.cover_cells(fields).collect()}
    assert [got[1, *at] for at in ((1, 1), (1, 3), (2, 2), (2, 4), (3, 2), (4, 2))] == ["科 目：物理", "", "力", "讲义", "目标 五年级", ""]
    assert got[2, 1, 1] == "科 目：" and got[2, 2, 4] == "" and len(got) == 12
    text = "五年级数学：第二单元 因数与倍数，掌握重难点题型"
    rows_ = spark.createDataFrame([(d, 1, "template", 1, text) for d in (1, 2, 3)] + [(1, 2, "source", 1, text)], "doc_id long, pos int, origin string, para int, text string")
    made = {(r.doc_id, r.origin): r.text for r in filling.covered(rows_, fields).collect()}
    assert made[1, "template"] == "五年级物理：力，目标 五年级" and made[2, "template"] == "高一数学：集合，掌握重难点题型"
    assert made[3, "template"] == text == made[1, "source"]


def test_the_whole_report(spark):
    texts = ["甲"] * 9 + ["基础训练"] + ["甲"] * 9 + ["能力提升"] + ["甲"] * 30
    f = paras(spark, texts).unionByName(paras(spark, ["甲"] * 10, 2))
    got = {r.doc_id: r.report.split("\n") for r in candidates.full_report(candidates.collected(f)).collect()}
    rule = "-" * 50
    assert got[2] == ["候选边界", rule, "即时训练候选", "  （无）", "巩固练习候选", "  （无）", "", "最终选择", rule, "即时训练开始: 未找到明确候选", "巩固练习开始: 未找到明确候选", "", "生成 blocks", rule, "  知识精讲: 1-4", "  即时训练: 5-7", "  六、巩固练习: 8-10", "合法性: 通过"]
    one = got[1]
    assert one[2] == "即时训练候选" and one[3].startswith("  [ 9") and "段落 10: 练习标记：" in one[3] and one[3].endswith(" | 基础训练")
    at = one.index("最终选择")
    assert one[at + 2].startswith("即时训练开始: 段落 10，练习标记：") and one[at + 3].startswith("巩固练习开始: 段落 20，巩固标记：")
    assert one[one.index("生成 blocks") + 2 :] == ["  知识精讲: 1-9", "  即时训练: 10-19", "  六、巩固练习: 20-50", "合法性: 通过"]
