"""Documents as ordered paragraph rows: doc_id, para (from 1), text, has_img."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space that becomes a plain space, and what is trimmed.
ODD_SPACE = "[\u3000\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\t\x0b\f\r]"

HANDOUTS = """
WITH r AS (
  SELECT o.o_custkey AS doc_id, l.*,
    CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate) AS INT) AS para,
    CAST(count(*) OVER (PARTITION BY o.o_custkey) AS INT) AS n
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey),
k AS (SELECT *, CAST(floor(n * 0.4) AS INT) AS q0, CAST(doc_id % 6 AS INT) AS v FROM r)
SELECT doc_id, para,
  CASE
    WHEN para = 1 THEN '知识梳理'
    WHEN para <= q0 AND para % 4 = 2 THEN concat('【例', para, '】判断 ', l_partkey, ' 是否成立')
    WHEN para <= q0 AND para % 7 = 5 THEN ''
    WHEN para <= q0 THEN concat('定义与公式：编号 ', l_partkey, ' 其中数量为 ', CAST(l_quantity AS INT))
    WHEN para = q0 + 1 THEN CASE v WHEN 0 THEN '【题型1 基本题型】' WHEN 1 THEN CASE WHEN doc_id % 12 = 1 THEN '【真题再现】' ELSE '【真题演练】' END WHEN 2 THEN '~~~~~~~~~~~~' WHEN 3 THEN '基础训练' ELSE '说明段落' END
    WHEN v = 2 AND para = q0 + 2 THEN '一、分层练习'
    WHEN v = 3 AND para = CAST(floor(n * 0.75) AS INT) THEN '能力提升'
    WHEN v = 5 THEN concat('普通段落 ', l_partkey)
    WHEN (para - q0) % 3 = 2 THEN concat(CAST(floor((para - q0 + 1) / 3.0) AS INT), '．（2024·卷', l_suppkey % 9, '）下列说法正确的是（  ）')
    WHEN (para - q0) % 3 = 0 THEN concat('A. ', l_partkey, '  B. ', l_suppkey)
    ELSE concat('【答案】', l_returnflag)
  END AS text,
  (para % 11 = 0) AS has_img
FROM k
"""

#: HANDOUTS as Spark runs them: the last two columns of the order don't go along, as lines that only they tell apart have the same text.
DRAWN = HANDOUTS.replace(", l.l_linestatus, l.l_shipdate)", ")")

#: The handouts with a table of contents before them: most with leader dots, some with short lines, some without either.
CONTENTS = """
WITH h AS ({handouts}),
t AS (
  SELECT d.doc_id, CAST(n AS INT) AS para, CASE n
    WHEN 1 THEN '目录'
    WHEN 2 THEN concat('知识梳理', CASE WHEN d.doc_id % 3 = 2 THEN '' ELSE '........ 1' END)
    WHEN 3 THEN CASE d.doc_id % 6 WHEN 0 THEN '题型1 基本题型..... 3' WHEN 1 THEN '真题 演练..... 4' WHEN 2 THEN '分层 练习' WHEN 3 THEN '基础训练...... 5' WHEN 4 THEN '第三章..... 6' ELSE '其他..... 7' END
    WHEN 4 THEN CASE d.doc_id % 6 WHEN 3 THEN '能力提升..... 9' WHEN 1 THEN '下列说法..... 8' ELSE '考情........ 8' END
    ELSE '' END AS text
  FROM (SELECT DISTINCT doc_id FROM h) d CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n)
SELECT doc_id, para, text, false AS has_img FROM t
UNION ALL SELECT doc_id, CAST(para + 5 AS INT) AS para, text, has_img FROM h
"""

#: The handouts as runs of text with colours, some of them near what counts as red: the first three characters of a paragraph and the rest.
RUNS = """
SELECT doc_id, para, run, CASE (doc_id + para + run) % 11 WHEN 0 THEN 'C00000' WHEN 1 THEN '640000' WHEN 2 THEN '630000' WHEN 3 THEN 'ff4646' WHEN 4 THEN 'FF4746' WHEN 5 THEN 'FF4647' WHEN 6 THEN 'red' WHEN 7 THEN NULL ELSE '000000' END AS colour, CASE run WHEN 1 THEN substring(text, 1, 3) ELSE substring(text, 4) END AS text
FROM ({handouts}) h CROSS JOIN (SELECT 1 AS run UNION ALL SELECT 2 AS run) r
"""


def normalised(text: Column) -> Column:
    spaced = F.regexp_replace(text, ODD_SPACE, " ")
    return F.regexp_replace(spaced, "^ +| +$", "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """The lines of ``docs`` (doc_id, text) as paragraphs; a null text has none."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.select("doc_id", (F.col("at") + 1).alias("para"), normalised(F.col("text")).alias("text"), F.lit(False).alias("has_img"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def settled(paras: DataFrame) -> DataFrame:
    """``paras`` with texts that are made once for each paragraph.

    A filter is moved below a column that it names, so that all its patterns would get a copy each of what makes the text;
    none is moved below an explosion.
    """
    return paras.select("doc_id", "para", F.explode_outer(F.array("text")).alias("text"), "has_img")


def handouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus rich in markers, one document for each customer, drawn from orders and their lines."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return settled(spark.sql(DRAWN, lineitem=read("lineitem"), orders=read("orders").select("o_orderkey", "o_custkey")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handouts as runs: doc_id, para, run, colour and text."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(RUNS.replace("{handouts}", DRAWN), lineitem=read("lineitem"), orders=read("orders").select("o_orderkey", "o_custkey"))


def with_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The handouts with tables of contents before them."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return settled(spark.sql(CONTENTS.replace("{handouts}", DRAWN), lineitem=read("lineitem"), orders=read("orders").select("o_orderkey", "o_custkey")))


#: Manifests of uploads: a customer's orders as the files of one job.
MANIFESTS = """
SELECT o_custkey AS job_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS pos,
  concat(
    CASE o_orderkey % 9 WHEN 0 THEN '第3讲 ' WHEN 1 THEN '【必考】' WHEN 2 THEN 'a/b 02 ' WHEN 3 THEN '~$' WHEN 4 THEN '第 12 章 考点01 ' ELSE '' END,
    CASE o_orderkey % 4 WHEN 0 THEN '三角函数 图象与性质' WHEN 1 THEN '导数的计算' WHEN 2 THEN '集合与函数概念' ELSE '2024-2025学年 高一数学专题' END,
    CASE o_orderstatus WHEN 'F' THEN ' 专题讲义 解析版' WHEN 'O' THEN '（学生版）' ELSE '' END,
    CASE o_orderkey % 7 WHEN 0 THEN '.zip' WHEN 1 THEN '.pdf' WHEN 2 THEN '.DOCX' ELSE '.docx' END) AS name,
  CAST(floor(o_totalprice) AS BIGINT) AS size
FROM {orders}
"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, pos, name and size of files, as uploads have them."""
    return spark.sql(MANIFESTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


#: Tables in the handouts, as spans of paragraphs; some reach over the end of another one.
TABLES = """
WITH h AS ({handouts}), n AS (SELECT doc_id, para, max(para) OVER (PARTITION BY doc_id) AS n FROM h)
SELECT doc_id, para AS start_para, CAST(least(para + 3, n) AS INT) AS end_para FROM n WHERE para % 9 = 4
UNION ALL SELECT doc_id, para AS start_para, CAST(least(para + 4, n) AS INT) AS end_para FROM n WHERE para % 9 = 6 AND (doc_id + para) % 4 = 0
UNION ALL SELECT doc_id, para AS start_para, para AS end_para FROM n WHERE para % 9 = 5
"""

#: Rows of three templates: for one pupil, for a class, and one that has no place for consolidation. Markers and layout are fixed values.
TEMPLATES = """
SELECT * FROM (VALUES
  ('1v1', 1, '讲义'), ('1v1', 2, ''), ('1v1', 3, ''), ('1v1', 4, '教学目标'), ('1v1', 5, '本节的知识精讲在后'), ('1v1', 6, ''), ('1v1', 7, '知识精讲'), ('1v1', 8, ''), ('1v1', 9, ''), ('1v1', 10, '即时训练（当堂）'), ('1v1', 11, ''), ('1v1', 12, '五、归纳总结'), ('1v1', 13, '六、巩固练习'), ('1v1', 14, '即时训练'), ('1v1', 15, ''),
  ('class', 1, '班课'), ('class', 2, '知识精讲&例题讲解'), ('class', 3, ''), ('class', 4, '即时训练'), ('class', 5, '六、出门测试'), ('class', 6, '五年级数学：第二单元 因数与倍数'), ('class', 7, '掌握重难点题型；质数和合数的概念以及综合运用'),
  ('short', 1, '即时训练'), ('short', 2, ''), ('short', 3, ''), ('short', 4, '知识精讲')) AS t(template, pos, text)
"""

#: Markers of the templates in the order in which anchors are given out.
MARKERS = """
SELECT * FROM (VALUES ('1v1', 1, '知识精讲'), ('1v1', 2, '即时训练'), ('1v1', 3, '六、巩固练习'), ('class', 1, '知识精讲&例题讲解'), ('class', 2, '即时训练'), ('class', 3, '六、出门测试'), ('short', 1, '知识精讲'), ('short', 2, '即时训练'), ('short', 3, '六、巩固练习')) AS m(template, rank, marker)
"""

#: Replies of a model about the handouts: good ones, ones in the wrong order, that name other paragraphs, that are broken, and none that is JSON.
REPLIES = """
WITH h AS ({handouts}), d AS (SELECT doc_id, CAST(max(para) AS INT) AS n, CAST(floor(max(para) * 0.4) AS INT) AS q0, CAST(floor(max(para) * 0.75) AS INT) AS q1 FROM h GROUP BY doc_id)
SELECT doc_id, CASE CAST(floor(doc_id / 6) AS INT) % 6
  WHEN 0 THEN concat('好的：{{"practice_start": ', q0 + 1, ', "consolidation_start": ', q1, ', "reason": " 基础在前 "}} 完')
  WHEN 1 THEN concat('{{"practice_start": "', q0 + 1, '", "consolidation_start": "', q1, '"}}')
  WHEN 2 THEN concat('{{"practice_start": ', q1, ', "consolidation_start": ', q0 + 1, ', "reason": "x"}}')
  WHEN 3 THEN concat('{{"practice_start": ', q0 + 1, ', "consolidation_start": ', n, ', "reason": null}}')
  WHEN 4 THEN concat('{{"practice_start": ', q0 + 1, ', "consolidation_start": ')
  ELSE '没有结果' END AS reply
FROM d
"""

#: Replies that name the blocks of the handouts: in order, out of order, with a kind twice, with one kind alone, with an unknown one, and broken.
BLOCK_REPLIES = """
WITH h AS ({handouts}), d AS (SELECT doc_id, CAST(max(para) AS INT) AS n, CAST(floor(max(para) * 0.4) AS INT) AS q0, CAST(floor(max(para) * 0.75) AS INT) AS q1 FROM h GROUP BY doc_id)
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN concat('{{"blocks": [{{"type": "knowledge", "start_para": 1}}, {{"type": "practice", "start_para": ', q0 + 1, '}}, {{"type": "consolidation", "start_para": ', q1 + 2, '}}]}}')
  WHEN 1 THEN concat('分块如下 {{"blocks": [{{"type": "consolidation", "start_para": ', q1 + 2, '}}, {{"type": "knowledge", "start_para": 1}}]}} 。')
  WHEN 2 THEN concat('{{"blocks": [{{"type": "practice", "start_para": 2}}, {{"type": "knowledge", "start_para": 1}}, {{"type": "practice", "start_para": ', q1 + 2, '}}]}}')
  WHEN 3 THEN '{{"blocks": [{{"type": "practice", "start_para": 2}}, {{"type": "knowledge", "start_para": "one"}}]}}'
  WHEN 4 THEN concat('{{"blocks": [{{"type": "summary", "start_para": 3}}, {{"type": "practice", "start_para": ', q0 + 1, '}}, {{"type": null, "start_para": 4}}]}}')
  ELSE concat('{{"blocks": [{{"type": "practice", "start_para": 2}}, ') END AS reply
FROM d
"""

#: Plans: orders as versions of handouts, in all modes; some name documents that there are none of.
VERSIONS = """
SELECT o_orderkey AS version_id, o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 100000000 ELSE 0 END AS doc_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'ideal' WHEN 2 THEN 'candidate' WHEN 3 THEN 'smart' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'smart' END END AS mode
FROM {orders}
"""

#: Relations of packages, a customer's orders each: some of the package's own, with gaps in their numbers, and those of its lines' sources.
OWN_RELATIONS = """
SELECT o_custkey AS package, concat(CASE WHEN n % 5 = 0 THEN 'ext' ELSE 'rId' END, CAST(n + n % 3 + CASE WHEN n > 4 THEN 7 ELSE 0 END AS INT)) AS rid, CASE o_orderkey % 2 WHEN 0 THEN 'image' ELSE 'oleObject' END AS kind, concat('media/', o_orderkey % 30) AS target
FROM (SELECT *, CAST(3 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n FROM {orders}) o WHERE n <= 21
"""
TAKEN_RELATIONS = """
SELECT o.o_custkey AS package, l.l_orderkey AS source, CAST(l.l_linenumber AS INT) AS nth, concat('rId', CAST(l.l_linenumber AS INT)) AS rid, CASE l.l_suppkey % 3 WHEN 0 THEN 'image' ELSE 'oleObject' END AS kind, concat('media/', l.l_partkey % 60) AS target
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

#: Blocks of the handouts with faults: too few, reversed, out of range, over one another; some documents there are none of.
FAULTY_BLOCKS = """
WITH h AS ({handouts}), d AS (SELECT doc_id, CAST(max(para) AS INT) AS n FROM h GROUP BY doc_id), e AS (SELECT doc_id, n, o FROM d CROSS JOIN (SELECT 1 AS o UNION ALL SELECT 2 AS o UNION ALL SELECT 3 AS o) x)
SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 100000000 ELSE 0 END AS doc_id, CAST(o AS INT) AS ord, CASE o WHEN 1 THEN '知识精讲' WHEN 2 THEN '即时训练' ELSE '六、巩固练习' END AS marker,
  CAST(CASE WHEN o = 1 THEN doc_id % 2 WHEN o = 2 THEN 2 + doc_id % 3 ELSE 6 END AS INT) AS start_para, CAST(CASE o WHEN 1 THEN 2 WHEN 2 THEN 5 - doc_id % 4 ELSE n + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END END AS INT) AS end_para
FROM e WHERE NOT (o = 3 AND doc_id % 7 = 0)
"""

#: The handouts as a word processor exports them: with encoded and real control characters.
MARKED = """
SELECT doc_id, para, concat(CASE para % 4 WHEN 0 THEN '_x0007_' WHEN 1 THEN chr(9) WHEN 2 THEN ' ' ELSE '_x00G7_' END, text, CASE para % 3 WHEN 0 THEN chr(11) WHEN 1 THEN concat('_x001f_', chr(13)) ELSE '' END, CASE para % 5 WHEN 0 THEN '_x000D_尾' ELSE '' END) AS text FROM ({handouts}) h
"""

#: Output of scripts, and the options of jobs, some unknown; a customer's orders are a job's.
LOGS = """
SELECT o_orderkey AS job_id, concat('start RED=', o_orderkey % 97, CASE o_orderkey % 3 WHEN 0 THEN concat(chr(10), 'DELETED=', o_custkey % 31, ' rows') WHEN 1 THEN ' DELETED=none' ELSE '' END, CASE o_orderkey % 2 WHEN 0 THEN concat(' BLANKS=', o_custkey, ' BLANKS=1') ELSE '' END) AS log FROM {orders}
"""
JOBS = """
SELECT DISTINCT o_custkey + CASE WHEN o_custkey % 13 = 0 THEN 100000000 ELSE 0 END AS job_id, CASE o_custkey % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'small' ELSE '1v1' END AS template_type, CASE o_custkey % 5 WHEN 0 THEN 'smart' WHEN 1 THEN 'full' WHEN 2 THEN 'ideal' WHEN 3 THEN 'candidate' ELSE CASE WHEN o_custkey % 3 = 0 THEN 'fast' ELSE 'smart' END END AS split_mode, CASE o_custkey % 4 WHEN 0 THEN 'separate' WHEN 1 THEN CASE WHEN o_custkey % 3 = 1 THEN '' ELSE 'auto' END ELSE 'auto' END AS docx_mode FROM {orders}
"""


def drawn(sql: str):
    """A corpus that ``sql`` draws from the orders and their lines."""

    whole = sql.replace("{handouts}", DRAWN)

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        given = {"orders": t("orders").select("o_orderkey", "o_custkey")} | ({"lineitem": t("lineitem")} if "{lineitem}" in whole else {})
        return spark.sql(whole, **given)

    return read


replies, block_replies, versions = drawn(REPLIES), drawn(BLOCK_REPLIES), drawn(VERSIONS)
own_relations, taken_relations = drawn(OWN_RELATIONS), drawn(TAKEN_RELATIONS)
faulty_blocks, marked, logs, jobs = drawn(FAULTY_BLOCKS), drawn(MARKED), drawn(LOGS), drawn(JOBS)


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What TABLES draws: no paragraph begins two tables, and as paragraphs count from 1, how many a document has tells all of them."""
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    lines = read("lineitem", "l_orderkey").join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = lines.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    p = F.col("para")
    rest = p % 9
    end = F.when(rest == 4, F.least(p + 3, "n")).when((rest == 6) & ((F.col("doc_id") + p) % 4 == 0), F.least(p + 4, "n")).when(rest == 5, p)
    every = n.select("doc_id", "n", F.explode(F.sequence(F.lit(1), "n")).alias("para"))
    return every.select("doc_id", p.alias("start_para"), end.cast("int").alias("end_para")).filter("end_para IS NOT NULL")


def templates(spark: SparkSession) -> DataFrame:
    return spark.sql(TEMPLATES)


def markers(spark: SparkSession) -> DataFrame:
    return spark.sql(MARKERS)
