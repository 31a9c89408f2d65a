"""Goldens of the tiers and of candidates, worked out by hand."""

from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import candidates, contents, hybrid, objectives, tiers


def paras(spark, texts, images=()):
    return spark.createDataFrame([(1, k, t, k in images) for k, t in enumerate(texts, 1)], "doc_id long, para int, text string, has_img boolean")


def split(spark, texts):
    rows = sorted(tiers.auto_split(paras(spark, texts)).collect(), key=lambda r: r.ord)
    return rows[0].tier, [(r.start_para, r.end_para) for r in rows]


def test_proportions_snap_to_empty_paragraphs(spark):
    assert split(spark, [f"段落{k}" for k in range(20)]) == ("proportional", [(1, 9), (10, 16), (17, 20)])
    texts = [f"段落{k}" for k in range(20)]
    texts[10] = ""  # paragraph 11; the second target, 17, is too far away
    assert split(spark, texts) == ("proportional", [(1, 10), (11, 16), (17, 20)])


def test_types_come_in_the_order_of_their_numbers(spark):
    texts = ["说明", "【题型2】", "甲", "【题型1】", "乙", "丙"]
    # the points are 4 and 2: the first of the two is where knowledge ends, and the third block begins before the second
    assert split(spark, texts) == ("type", [(1, 3), (4, 1), (2, 6)])


def test_separator_is_decoration_behind_practice(spark):
    plain = ["说明", "~~~~~~~~~~~~", "即时训练的题", "甲", "乙", "丙"]
    assert split(spark, plain) == ("separator", [(1, 2), (3, 5), (6, 6)])
    assert split(spark, ["【真题演练】", *plain[1:]])[0] == "score"


def test_cuts_spare_reading_passages(spark):
    texts = ["说明", "【真题再现】", "a", "b", "c", "d", "【解题技巧】", "e"]
    # the boundary is paragraph 2; seven tenths of the rest end at 6, where the passage ends as well
    assert split(spark, texts) == ("score", [(1, 1), (2, 6), (7, 8)])
    longer = [*texts[:6], "e", "f", "g", "【解题技巧】"]
    assert split(spark, longer) == ("score", [(1, 1), (2, 9), (10, 10)])


def test_pictures_go_with_what_follows(spark):
    blocks = spark.createDataFrame([(1, 1, "k", 1, 4), (1, 2, "d", 5, 6)], "doc_id long, ord int, marker string, start_para int, end_para int")
    p = paras(spark, ["甲", "乙", "", "~~", "丙", "丁"], images=(3, 4))
    got = sorted((r.ord, r.start_para, r.end_para) for r in tiers.images_moved(blocks, p).collect())
    assert got == [(1, 1, 2), (2, 3, 6)]


def test_example_groups(spark):
    texts = ["【题型1】", "1．（2024·卷）甲", "解", "2．（2024·卷）乙", "【题型2】", "1．（2024·卷）丙", "【题型3】", "1．（2024·卷）丁", "解"]
    got = sorted((r.start_para, r.end_para, r.sound) for r in tiers.example_groups(paras(spark, texts)).collect())
    assert got == [(2, 3, False), (8, 9, False)]


def test_contents_give_no_candidates(spark):
    found = candidates.collected(paras(spark, ["04 真题闯关·演练", "05 课后三阶·练习", "甲", "04 真题闯关·演练", "乙", "丙", "丁", "05 课后三阶·练习", "戊"]))
    got = sorted((r.kind, r.para, r.score) for r in candidates.merged(found).collect())
    assert got == [("consolidation_start", 8, 98), ("practice_start", 4, 97)]
    assert tuple(candidates.review(found).first()) == (1, False, "离线候选足够明确")
    lines = {r.kind: r.lines for r in candidates.report(found).collect()}
    assert lines["practice_start"] == "  [ 97] 段落 4: 学科网 04 练习章节；练习标记：真题闯关 | 04 真题闯关·演练"
    assert sorted((r.start_para, r.end_para) for r in candidates.candidate_blocks(found).collect()) == [(1, 3), (4, 7), (8, 9)]


def test_contents_names_and_roles(spark):
    df = spark.createDataFrame([("真题·命题..................... 30",), ("考情...7",), ("第三章",), ("说明",)], "t string")
    got = [tuple(r) for r in df.select(scalars.clean_toc_name(F.col("t")), scalars.toc_role(F.col("t"))).collect()]
    assert got == [("真题·命题", "basic_practice"), ("考情", "knowledge"), ("第三章", "practice"), ("说明", None)]


def test_hybrid_split(spark):
    texts = [
        "知识梳理", "1. 集合的概念：具有某种特定性质的对象的总体。", "2. 确定性：一个对象要么属于这个集合，要么不属于。", "3. 互异性：集合中的元素是互不相同的。", "【例1】判断以下对象能否构成集合：", "(1) 大于3小于11的偶数；", "(2) 我国的小河流。",
        "【解析】(1) 能构成集合，因为元素是确定的。", "题型1 集合的基本概念", "1. （2024·北京）下列各组对象中能构成集合的是（  ）", "A. 著名的数学家  B. 接近0的数", "C. 2024年世界杯参赛队  D. 某校的高个子学生", "2. 若集合A={1,3}，则A的子集个数为（  ）", "A. 2  B. 3  C. 4  D. 8",
        "3. 设全集U={1,2,3,4,5}，集合A={1,2,3}，则∁UA=（  ）", "A. {4,5}  B. {1,2,3}  C. {5}  D. {1,2,3,4,5}", None, "5. 用列举法表示下列集合：", "(1) 方程x²-3x+2=0的解集；", "(2) 大于0且小于10的奇数。",
    ]
    p = paras(spark, texts).filter("text IS NOT NULL")
    assert sorted((r.ord, r.start_para, r.end_para) for r in hybrid.split(p).collect()) == [(1, 1, 5), (2, 6, 15), (3, 16, 20)]


def test_classes_depend_on_what_went_before(spark):
    got = [(r.category, r.confidence) for r in hybrid.classified(paras(spark, ["知识回顾", "Lesson 概念的说明文字在这里写得足够长了吧", "题型1", "Lesson 概念的说明文字在这里写得足够长了吧", "", "甲"])).orderBy("para").collect()]
    # 50 + 30 (heading) + 15 (concept) + 5 or 0 (place) + 10 or - 10 (before it)
    assert got == [("knowledge", 0.95), ("knowledge", 1.0), ("practice", 1.0), ("knowledge", 0.85), ("practice", 0.55), ("practice", 0.55)]


def toc(spark, texts):
    return sorted((r.ord, r.marker, r.start_para, r.end_para) for r in contents.split(paras(spark, texts)).collect())


def test_contents_name_the_blocks(spark):
    listed = ["目录", "知识梳理...... 1", "基础训练...... 3", "能力提升...... 5", ""]
    body = ["知识梳理", "甲", "基础训练（一）", "1．题", "二、能力 提升", "2．题"]
    assert toc(spark, [*listed, *body]) == [(1, "知识精讲", 1, 7), (2, "即时训练", 8, 9), (3, "六、巩固练习", 10, 11)]
    # without the advanced heading in the body all practice is one block
    assert toc(spark, [*listed, *body[:4]]) == [(1, "知识精讲", 1, 7), (2, "即时训练", 8, 9)]
    e = contents.entries(paras(spark, [*listed, *body])).first()
    assert e.toc_end == 5 and [(x.para, x.role) for x in e.entries] == [(2, "knowledge"), (3, "basic_practice"), (4, "advanced_practice")]


def test_headings_stand_in_for_contents(spark):
    assert toc(spark, ["说明", "⚡基础速刷", "1．题", "【能力跃升】", "2．题"]) == [(1, "知识精讲", 1, 1), (2, "即时训练", 2, 3), (3, "六、巩固练习", 4, 5)]
    assert toc(spark, ["说明", "一、能力提升", "1．题"]) == [(1, "知识精讲", 1, 1), (2, "六、巩固练习", 2, 3)]
    assert toc(spark, ["说明", "甲"]) == []


def test_full_width_digits_count(spark):
    assert split(spark, ["说明", "【题型２】", "甲", "【题型１】", "乙", "丙"]) == ("type", [(1, 3), (4, 1), (2, 6)])


def test_objectives(spark):
    texts = ["知识点1：集合的定义", "一、集合的运算", "二、巩固练习", "【题型1】集合的判定", "题型2 求子集", "1．甲", "3．乙", "2．丙", "例1 丁", "基础速刷", "一、集合的运算"]
    f = objectives.features(paras(spark, texts))
    assert tuple(f.first())[1:] == (["集合的定义", "集合的运算"], ["集合的判定", "求子集"], ["基础速刷"], 2, 1)
    got = objectives.objectives(f, F.lit("集合")).first()
    assert got.objectives == "①掌握集合核心知识：集合的定义、集合的运算等；\n②掌握集合的判定、求子集等题型的解法，共2道题；\n③培养运算与推理能力，形成知识体系。"
    assert got.difficulties == "重点：集合核心概念（集合的定义、集合的运算）的理解与应用；\n难点：集合的判定、求子集等的综合运用与易错点辨析。"
    bare = objectives.objectives(objectives.features(paras(spark, ["", "甲"])), F.lit("集合")).first()
    assert bare.objectives.split("\n")[1] == "②掌握本专题典型问题题型的解法，熟练求解；" and bare.difficulties.split("\n")[1] == "难点：知识的综合运用与易错点辨析。"
