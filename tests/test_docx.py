"""The docx source and sink: round trips, archives, and a document far larger than the memory it may take."""

import io
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import docx


def test_round_trip(spark, tmp_path):
    texts = {"甲-教师版": ["知识精讲", "", "a < b & \"c\"", " 空 格 ", "tab\tend"], "乙": ["一"] * 2500, "丙": [None]}
    rows = [(n, k, t) for n, ts in texts.items() for k, t in enumerate(ts, 1)]
    df = spark.createDataFrame(rows, "name string, pos int, text string").repartition(5)
    docx.save_docx(df, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name[0] not in "._"} == {f"{n}.docx" for n in texts}
    got = docx.load_docx(spark, str(tmp_path / "out")).withColumn("name", F.regexp_extract("path", r"([^/]*)\.docx$", 1))
    assert {n: [r.text for r in got.filter(F.col("name") == n).orderBy("para").collect()] for n in texts} == {n: [(t or "").strip() for t in ts] for n, ts in texts.items()}
    docx.save_docx(df.filter("name = '丙'"), str(tmp_path / "out"))  # again: replaced
    assert got.filter("name = '丙'").count() == 1
    assert (tmp_path / "out" / "_SUCCESS").read_text() == "1"


def test_columns_are_pruned(spark, tmp_path):
    docx.save_docx(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "name string, pos int, text string"), str(tmp_path))
    got = docx.load_docx(spark, str(tmp_path), ["para", "has_img"])
    assert got.columns == ["para", "has_img"] and sorted(tuple(r) for r in got.collect()) == [(1, False), (2, False)]


def package(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def body(*parts: str) -> str:
    return f'<w:document xmlns:w="{docx.NAMESPACE}"><w:body>{"".join(parts)}</w:body></w:document>'


def p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_tables_and_nested_paragraphs():
    table = f"<w:tbl><w:tr><w:tc>{p('格1')}{p('')}</w:tc><w:tc><w:tbl><w:tr><w:tc>{p('内')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    boxed = f"<w:p><w:r><w:t>外</w:t></w:r><w:r><w:pict><w:txbxContent>{p('框')}</w:txbxContent></w:pict></w:r><w:r><w:t>后</w:t></w:r></w:p>"
    got = list(docx.paragraphs(io.BytesIO(body(p("一"), table, boxed, p("二"), table).encode())))
    assert got == [(1, "一", False, False, None), (1, "格1", False, True, 1), (1, "", False, True, 1), (1, "内", False, True, 1), (2, "外框后", True, False, None), (3, "二", False, False, None), (3, "格1", False, True, 2), (3, "", False, True, 2), (3, "内", False, True, 2)]
    assert list(docx.paragraphs(io.BytesIO(body().encode()))) == []


def test_broken_documents_give_what_stands_before(spark, tmp_path):
    (tmp_path / "cut.docx").write_bytes(package(body(p("一"), p("二"))[:-30]))
    (tmp_path / "no.docx").write_bytes(b"")
    (tmp_path / "other.docx").write_bytes(b"x" * 5000)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/b.docx", package(body(p("三"))))
        z.writestr("in/c.docx", b"no package")
    got = docx.load_docx(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["一", "三"] or sorted(r.text for r in got) == ["一", "三", "二"]
    assert docx.load_docx(spark, str(tmp_path), archives="only").first().path.endswith("a.zip!in/b.docx")


@pytest.mark.parametrize("name", ["../x.docx", "/x.docx", "a/../../x.docx", "C:\\x.docx", "..\\x.docx"])
def test_members_that_lead_out_are_refused(tmp_path, name):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(name, package(body(p("x"))))
    with pytest.raises(ValueError, match="lead out"):
        docx.Reader(str(tmp_path), ["text"], "also").partitions()
    assert not docx.climbs("a..b/c...docx")


MEASURED = """
import resource, sys
from quillstone.sources import docx
part, = docx.Reader(sys.argv[1], ["para", "text"], "also").partitions()
reader = docx.Reader(sys.argv[1], ["para", "text"], "also")
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(b.num_rows for b in reader.read(part))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_large_archive_takes_little_memory(tmp_path):
    """A document of 200 MB inside an archive."""
    text = p("字" * 1300 + "x" * 100)
    n = 200_000_000 // len(text.encode())
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as outer, outer.open("in/large.docx", "w") as inner, zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("word/document.xml", "w") as xml:
        xml.write(f'<w:document xmlns:w="{docx.NAMESPACE}"><w:body>'.encode())
        for lo in range(0, n, 1000):
            xml.write((text * min(1000, n - lo)).encode())
        xml.write(b"</w:body></w:document>")
    said = subprocess.run([sys.executable, "-c", MEASURED, str(tmp_path)], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(said[0]) == n and int(said[1]) < 60
