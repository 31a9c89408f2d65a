"""Documents as a Spark data source: ``docx`` reads and writes word processing documents.

    spark.read.format("docx").load(folder)                    # path, para, text, has_img, in_table, table
    rows.write.format("docx").mode("append").save(folder)     # name, pos, text: a document for each name

Reading has a partition for each file, and one for each document inside a zip archive. XML is read as a stream and dropped
paragraph by paragraph, so that a document of any size takes the memory of its largest paragraph. Writing expects the rows of a
document together and in order, as ``save_docx`` places them; each document is written under a name of its own beside its
place and moved there when it is complete, so that a lost task leaves no half document and one that runs twice does no harm.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, para int, text string, has_img boolean, in_table boolean, table int"
#: Namespace of word processing documents.
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W = f"{{{NAMESPACE}}}"
#: Rows and characters of text of a batch.
ROWS, CHARACTERS = 1_000, 1 << 20
#: What a package has besides the document. Fixed values.
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: What opening a file that is no package, or a short one, raises.
NOT_ZIP = (zipfile.BadZipFile, KeyError, pa.ArrowInvalid)
#: Characters that XML can't have, white space apart.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its place there; any that pyarrow knows, the local one for a path without a scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+://", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


def wanted(name: str) -> bool:
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    return base.lower().endswith(".docx") and not base.startswith("~$")


def climbs(name: str) -> bool:
    """Whether a member's name leads out of its archive."""
    plain = name.replace("\\", "/")
    return plain.startswith("/") or bool(re.match("[A-Za-z]:", plain)) or ".." in plain.split("/")


def paragraphs(xml) -> Iterator[tuple[int, str, bool, bool, int | None]]:
    """(para, text, has_img, in_table, table) of a document's XML, a stream.

    Paragraphs directly in the body are counted from 1; those in tables have the number of the last one before the table,
    and the table's own number. What is nested in a paragraph is part of it.
    """
    at, tables, deep, body = 0, 0, [], None
    text: list[str] = []
    picture = False
    for event, e in ElementTree.iterparse(xml, ("start", "end")):
        if event == "start":
            if body is None:
                body = e if e.tag == f"{W}body" else None
                continue
            if not deep and e.tag in (f"{W}p", f"{W}tbl"):
                at, tables = at + (e.tag == f"{W}p"), tables + (e.tag == f"{W}tbl")
            if e.tag == f"{W}p" and f"{W}p" not in deep:
                text, picture = [], False
            deep.append(e.tag)
        elif body is not None and deep:
            deep.pop()
            inside = f"{W}p" in deep
            if e.tag == f"{W}t" and inside:
                text.append(e.text or "")
            picture |= e.tag in (f"{W}drawing", f"{W}pict")
            if e.tag == f"{W}p" and not inside:
                table = bool(deep)
                yield at, "".join(text).strip(), picture, table, tables if table else None
            if not inside:
                e.clear()  # what is done with is dropped: paragraphs, and what tables have between them
            if not deep:
                body.clear()


@dataclass
class Part(InputPartition):
    """A document: a file, or a member of an archive."""

    file: str
    member: str | None


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], archives: str):
        self.path, self.columns, self.archives = path, columns, archives

    def partitions(self) -> list[Part]:
        """Lists files and the archives' directories; no document is read. A broken archive has none; one whose members lead out of it is refused."""
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        out = []
        for path in sorted(f.path for f in files if f.type == pafs.FileType.File):
            if wanted(path) and self.archives != "only":
                out.append(Part(path, None))
            elif path.lower().endswith(".zip") and self.archives != "none":
                try:
                    with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        names = z.namelist()
                except NOT_ZIP:
                    continue
                if any(map(climbs, names)):
                    raise ValueError(f"{path} has members that lead out of it")
                out += [Part(path, n) for n in names if wanted(n)]
        return out or [Part("", None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A document that is none, or breaks off, gives the paragraphs up to there."""
        if not part.file:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(part.file) as f:
            try:
                if part.member is None:
                    yield from self.rows(f, part.file)
                else:
                    with zipfile.ZipFile(f) as outer, outer.open(part.member) as inner:
                        yield from self.rows(inner, f"{part.file}!{part.member}")
            except NOT_ZIP:
                return

    def rows(self, package, path: str) -> Iterator[pa.RecordBatch]:
        names = ["path", "para", "text", "has_img", "in_table", "table"]
        types = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int32()]
        keep = [names.index(c) for c in self.columns]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(columns[k], types[k]) for k in keep], names=self.columns)

        with zipfile.ZipFile(package) as z, z.open("word/document.xml") as xml:
            try:
                for row in paragraphs(xml):
                    held.append((path, *row))
                    size += len(row[1])
                    if len(held) >= ROWS or size >= CHARACTERS:
                        yield batch()
                        held, size = [], 0
            except ElementTree.ParseError:
                pass
        if held:
            yield batch()


@dataclass
class Saved(WriterCommitMessage):
    documents: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Saved:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        saved, open_name, held = 0, None, None
        for batch in iterator:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                if name != open_name:
                    saved += self.close(fs, held)
                    open_name, held = name, self.open(fs, root, name)
                held[3].write(f'<w:p><w:r><w:t xml:space="preserve">{escape(NOT_XML.sub("", text or ""))}</w:t></w:r></w:p>'.encode())
        saved += self.close(fs, held)
        return Saved(saved)

    def open(self, fs: pafs.FileSystem, root: str, name: str) -> tuple:
        if climbs(name) or "/" in name:
            raise ValueError(f"{name} is no name of a document")
        staged = f"{root}/_{uuid.uuid4().hex}"
        out = fs.open_output_stream(staged)
        z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        z.writestr("[Content_Types].xml", CONTENT_TYPES)
        z.writestr("_rels/.rels", RELATIONS)
        xml = z.open("word/document.xml", "w", force_zip64=True)
        xml.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{NAMESPACE}"><w:body>'.encode())
        return staged, f"{root}/{name}.docx", (out, z), xml

    def close(self, fs: pafs.FileSystem, held: tuple | None) -> int:
        if held is None:
            return 0
        staged, to, (out, z), xml = held
        xml.write(b"<w:sectPr/></w:body></w:document>")
        xml.close()
        z.close()
        out.close()
        fs.move(staged, to)
        return 1

    def commit(self, messages: list[Saved | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.documents for m in messages if m is not None)).encode())


class Docx(DataSource):
    """``docx``: see the module. Options: path; archives: also, none or only. A schema given to the reader may leave columns out, which are then not made."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), self.options.get("archives", "also"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def load_docx(spark: SparkSession, path: str, columns: list[str] | None = None, archives: str = "also") -> DataFrame:
    """The paragraphs of the documents under ``path``, in files and zip archives; ``columns`` alone, if they are given."""
    spark.dataSource.register(Docx)
    reader = spark.read.format("docx").option("archives", archives)
    if columns is not None:
        kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def save_docx(rows: DataFrame, path: str) -> None:
    """Writes a document for each name of ``rows`` (name, pos, text) into the folder ``path``; a document there of the same name is replaced."""
    rows.sparkSession.dataSource.register(Docx)
    placed = rows.select("name", "pos", "text").repartition("name").sortWithinPartitions("name", "pos")
    placed.write.format("docx").mode("append").save(path)
