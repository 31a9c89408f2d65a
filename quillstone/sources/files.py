"""Documents and plans from files: docx, zip archives of docx, scan output and plans in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docx import load_docx

PARAGRAPHS = ["path", "para", "text", "has_img", "in_table"]


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The paragraphs of the docx files under ``path``; lock files (~$) are left out, and a file that is no docx gives none."""
    return load_docx(spark, path, PARAGRAPHS, "none")


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, size, content) of the docx files in the zip archives under ``path``. A broken archive has none."""
    import zipfile

    import pyarrow as pa

    def run(batches):
        import io

        for b in batches:
            for k in range(b.num_rows):
                try:
                    z = zipfile.ZipFile(io.BytesIO(b.column(1)[k].as_py()))
                except zipfile.BadZipFile:
                    continue
                for info in z.infolist():
                    base = info.filename.rsplit("/", 1)[-1]
                    if base.lower().endswith(".docx") and not base.startswith("~$"):
                        yield pa.RecordBatch.from_pydict({"archive": [b.column(0)[k].as_py()], "name": [info.filename], "size": pa.array([info.file_size], pa.int64()), "content": [z.read(info)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "archive string, name string, size long, content binary")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The paragraphs of the docx files in the zip archives under ``path``; path is archive!name."""
    return load_docx(spark, path, PARAGRAPHS, "only")


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """path, para, text and has_img from scan output: lines of number, text and 0 or 1 between tabs, of which the last two may lack."""
    line = F.split("value", "\t")
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), line.alias("p")).filter(F.trim(F.get("p", F.lit(0))).rlike("^[0-9]+$"))
    return rows.select("path", F.trim(F.get("p", F.lit(0))).cast("int").alias("para"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("text"), F.coalesce(F.trim(F.get("p", F.lit(2))) == "1", F.lit(False)).alias("has_img"))


PLAN = "template string, versions array<struct<label:string,source:string,output:string,topic:string,objectives:string,difficulties:string,blocks:array<struct<marker:string,start:int,end:int>>>>"


def read_plans(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """A row for each block of each version of the plans (JSON files) under ``path``; ord counts a version's blocks from 1.

    folder: where a template stands that is named by a relative path.
    """
    plans = spark.read.schema(PLAN).json(path, multiLine=True).select(F.input_file_name().alias("path"), "template", F.explode("versions").alias("v"))
    if folder is not None:
        absolute = F.col("template").rlike(r"^(/|\\\\|[A-Za-z]:)")
        plans = plans.withColumn("template", F.when(absolute, F.col("template")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "template")))
    own = ["path", "template", "v.label", "v.source", "v.output", "v.topic", "v.objectives", "v.difficulties"]
    blocks = plans.select(*own, F.posexplode_outer("v.blocks").alias("at", "b"))
    return blocks.select(*(c.removeprefix("v.") for c in own), (F.col("at") + 1).alias("ord"), "b.marker", F.col("b.start").alias("start_para"), F.col("b.end").alias("end_para"))
