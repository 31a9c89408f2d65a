"""What keeps the cost of large corpora down: texts made once, patterns tried once, corpora read once."""

from pyspark.sql import functions as F

from quillstone.functions import matching
from quillstone.functions import patterns as P
from quillstone.operators import assembly, contents, scoring, segments
from quillstone.plans import registry
from quillstone.sources import corpora

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_once(spark):
    # the filter on the role used to bring a copy of what makes the text with each of its patterns
    for name in ("toc_role", "scan_grep"):
        assert plan(registry.QUERIES[name](spark, SF)).count("定义与公式") == 1, name


def test_scores_are_one_pass(spark):
    for name in ("handout_scores", "para_scores"):
        assert "RLIKE" not in plan(registry.QUERIES[name](spark, SF)) and plan(registry.QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1, name


def test_kernels_find_what_rlike_finds(spark):
    texts = ["", None, "１２．（２０２４·卷）甲", "【例1】x", "A．甲", "第三部分", "passage 3", "PART A", "目录......", "（ ）", "甲__", "=a/÷", "~" * 12, "题型２", "04 真题·演练", "0４ 真题·演练", "0٤ 甲·乙", "第3章", "B组", "如图，下图正确", "知识点" + "甲" * 100]
    t = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id int, text string")
    tables = [p for p, _ in P.QUESTION + P.KNOWLEDGE + P.SECTION] + P.BOUNDARY
    names = {f"p{k}": p for k, p in enumerate(tables)}
    got = {r.doc_id: r for r in matching.with_tried(t, names).collect()}
    want = {r.doc_id: r for r in t.select("doc_id", *(F.col("text").rlike(p).alias(n) for n, p in names.items())).collect()}
    assert all(got[k][n] == want[k][n] for k in got for n in names)
    scored = scoring.scored(t).withColumns({"q2": scoring.weight(F.col("text"), P.QUESTION), "k2": scoring.weight(F.col("text"), P.KNOWLEDGE)}).collect()
    assert all((r.q, r.k) == (r.q2, r.k2) for r in scored)
    types = {r.text: r.section_type for r in scored}
    assert [types[x] for x in ("第三部分", "passage 3", "目录......", "题型２", "04 真题·演练", "甲__", None)] == ["mixed", "practice", "toc", "practice", "practice", None, None]


def test_corpora_are_read_once(spark):
    # how often the lines are read; each was more: 44, 28, 10, 5, 7, 4 and 8
    for name, most in (("smart_blocks", 15), ("version_blocks", 14), ("missing_anchors", 2), ("blocks_widened", 2), ("full_report", 1), ("refined_blocks", 2), ("hybrid_tiers", 1)):
        assert plan(registry.QUERIES[name](spark, SF)).count("Relation [l_orderkey") <= most, name


def test_blocks_carry_what_they_need(spark):
    # the section's 62 patterns were tried for blocks as well, and two columns went along that change no text
    assert "section_type" not in segments.marked(corpora.handouts(spark, SF)).columns
    assert "l_shipdate" not in plan(registry.QUERIES["split_blocks_scored"](spark, SF)).split("Relation")[0]


def test_candidates_are_found_once(spark):
    # the filter of an explosion had copies of what finds them; the fold of their numbers stood in the plan 15 times
    for name in ("candidates", "candidate_report", "question_density"):
        assert plan(registry.QUERIES[name](spark, SF)).count("aggregate(") == 1, name


def test_templates_are_filled_from_one_pass(spark):
    # the blocks were worked out for the template's rows and once more for those that are pasted
    for name in ("filled_rows", "filled_trimmed"):
        assert plan(registry.QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1, name
    # tables follow from counts; no paragraph is put in order for them
    assert "l_linenumber" not in plan(corpora.tables(spark, SF)).split("Relation")[0]


def test_blocks_are_checked_in_their_pass(spark):
    # extents and pictures were gathered in a pass of their own and joined
    for name in ("validate_blocks", "image_fix"):
        assert plan(registry.QUERIES[name](spark, SF)).count("Relation [l_orderkey") == 1, name
    made = "array(named_struct('ord', 1, 'marker', 'a', 'start_para', 1, 'end_para', 5), named_struct('ord', 2, 'marker', 'b', 'start_para', 5, 'end_para', 4), named_struct('ord', 3, 'marker', 'c', 'start_para', 6, 'end_para', 99))"
    got = assembly.validated_rows(spark.sql(f"SELECT 1 AS doc_id, 1 AS first, 20 AS last, {made} AS made UNION ALL SELECT 2, 1, 5, slice({made}, 1, 1)")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {1: (False, True, True, True), 2: (True, False, False, False)}


def test_texts_are_not_sorted_for_blocks(spark):
    assert "strategy=shuffle_hash" in plan(registry.QUERIES["assemble_rows"](spark, SF))


def test_names_and_extents_are_one_pass(spark):
    # a document's extent was gathered in a pass of its own, and grams of every paragraph were made for its names
    assert plan(registry.QUERIES["toc_split"](spark, SF)).count("Relation [l_orderkey") < 12
    p = spark.createDataFrame([(1, k, x, False) for k, x in enumerate(["目录", "甲", "", "乙练习", "乙 练习", "乙练习题", "丙训练"], 1)] + [(2, 3, "甲", False)], "doc_id long, para int, text string, has_img boolean")
    names = "array(named_struct('para', 2, 'role', 'practice', 'name', '乙 练习'), named_struct('para', 3, 'role', 'practice', 'name', '丙训练'), named_struct('para', 4, 'role', 'practice', 'name', '乙'))"
    got = {r.doc_id: (r.first, r.last, [x.para for x in r.places]) for r in contents.surveyed(spark.sql(f"SELECT 1L AS doc_id, 4 AS toc_end, {names} AS entries"), p).select(F.col("doc_id"), F.col("first").alias("first"), "last", "places").collect()}
    # its own name goes before one that only has its letters; a name of one letter isn't looked for
    assert got == {1: (1, 7, [5, 7]), 2: (3, 3, [])}
