"""Files that the tests write, read again; manifests and topics by hand."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import manifests
from quillstone.sources import files

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>')
    return out.getvalue()


def p(*runs, picture=False):
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "<w:r><w:drawing/></w:r>" * picture + "</w:p>"


BODY = docx(p("知识", "梳理 "), p(), f"<w:tbl><w:tr><w:tc>{p('格')}</w:tc></w:tr></w:tbl>", p("图", picture=True))
ROWS = [(1, "知识梳理", False, False), (2, "", False, False), (2, "格", False, True), (3, "图", True, False)]


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(BODY)
    (tmp_path / "~$a.docx").write_bytes(BODY)
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = files.read_docx(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(ROWS) and {r.path.rsplit("/", 1)[-1] for r in got} == {"a.docx"}


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("in/教师版.docx", BODY)
        z.writestr("in/~$x.docx", b"")
        z.writestr("notes.txt", b"x")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    assert [(r.name, r.size) for r in files.members(spark, str(tmp_path)).collect()] == [("in/教师版.docx", len(BODY))]
    got = files.read_zip(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(ROWS) and got[0].path.endswith("s.zip!in/教师版.docx")


def test_scan_output(spark, tmp_path):
    (tmp_path / "scan.txt").write_text("1\t甲\t0\n2\t乙\t1\n3\t丙\n4\nDONE\n", "utf-8")
    got = sorted(tuple(r)[1:] for r in files.read_scan(spark, str(tmp_path)).collect())
    assert got == [(1, "甲", False), (2, "乙", True), (3, "丙", False), (4, "", False)]


def test_plans(spark, tmp_path):
    plan = {"template": "t.docx", "versions": [{"label": "教师版", "source": "s.docx", "output": "o.docx", "topic": "集合", "blocks": [{"marker": "知识精讲", "start": 1, "end": 4}, {"marker": "即时训练", "start": 5, "end": 9}]}, {"label": "学生版"}]}
    (tmp_path / "plan.json").write_text(json.dumps(plan, ensure_ascii=False, indent=1), "utf-8")
    got = sorted((r.label, r.ord, r.marker, r.start_para, r.end_para) for r in files.read_plans(spark, str(tmp_path)).filter("ord IS NOT NULL").collect())
    assert got == [("教师版", 1, "知识精讲", 1, 4), ("教师版", 2, "即时训练", 5, 9)]
    assert files.read_plans(spark, str(tmp_path)).count() == 3
    assert {r.template for r in files.read_plans(spark, str(tmp_path), "/app/").collect()} == {"/app/t.docx"}
    first = files.read_plans(spark, str(tmp_path)).filter("label = '教师版'").first()
    assert (first.objectives, first.difficulties) == (plan["versions"][0].get("objectives"), plan["versions"][0].get("difficulties"))


@pytest.fixture(scope="module")
def manifest(spark):
    jobs = [["讲义（教师版）.docx", "讲义（学生版）.docx"], ["notes.txt", "a.docx"], ["A.docx", "a.DOCX"], ["b.docx", "c.docx", "d.zip"], ["~$b.docx"], ["x/学生 解析.docx", "解析 学生.docx"]]
    rows = [(j, k, n, 10 * k) for j, names in enumerate(jobs, 1) for k, n in enumerate(names, 1)]
    return spark.createDataFrame(rows, "job_id long, pos int, name string, size long")


def test_uploads_are_checked(manifest):
    errors = {r.job_id: r.error for r in manifests.accepted(manifest).collect()}
    assert errors == {1: None, 2: "仅支持 ZIP 和 DOCX，请移除无效文件", 3: "存在同名文件，请先重命名，避免素材覆盖", 4: None, 5: "仅支持 ZIP 和 DOCX，请移除无效文件", 6: None}


def test_uploads_are_grouped(manifest):
    got = sorted(tuple(r) for r in manifests.inputs(manifest).filter("job_id IN (1, 4)").collect())
    assert got == [(1, 1, "docx", "讲义（教师版）.docx + 讲义（学生版）.docx", 2), (4, 1, "zip", "d.zip", 1), (4, 2, "docx", "b.docx + c.docx", 2)]
    assert manifests.inputs(manifest, auto=False).filter("job_id = 4").count() == 3


def test_versions_are_told_apart(manifest):
    got = {r.job_id: (r.teacher, r.student) for r in manifests.versions(manifest).collect()}
    assert got[1] == ("讲义（教师版）.docx", "讲义（学生版）.docx")
    assert got[4] == ("c.docx", "b.docx")  # the larger is the teacher's
    assert got[2] == ("a.docx", None)
    assert got[6] == ("x/学生 解析.docx", "解析 学生.docx")


def test_topics(spark):
    names = ["导数的计算 专题讲义 解析版", "三角函数 图象与性质 训练题 学生版", "集合与函数概念（教师版）", "dir/02 计数原理.docx", "讲义.docx", "【必考】第3讲 向量-练习.docx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(scalars.topic(F.col("n"))).collect()]
    assert got == ["导数的计算", "三角函数 图象与性质", "集合与函数概念", "计数原理", "讲义", "向量"]
    assert df.limit(1).select(scalars.topic(F.lit("讲义.docx"), F.lit("包"))).first()[0] == "包"
