"""Manifests of uploaded files: which are refused, what they are grouped into, and which is the teacher's version."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P


def base(name: Column) -> Column:
    """A name without its folders."""
    return F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1)


def is_docx(name: Column) -> Column:
    return F.lower(name).endswith(".docx") & ~base(name).startswith("~$")


def checked(files: DataFrame) -> DataFrame:
    """job_id, pos, name (without folders) and error (null if none) for files (job_id, pos, name): neither lock files nor other kinds, and no name twice."""
    own = files.select("job_id", "pos", base(F.col("name")).alias("name"))
    kind = (F.col("name") == "") | F.col("name").startswith("~$") | ~F.lower("name").rlike(r"\.(zip|docx)$")
    again = F.row_number().over(Window.partitionBy("job_id", F.lower("name")).orderBy("pos")) > 1
    return own.withColumn("error", F.when(kind, P.BAD_KIND).when(again, P.SAME_NAME))


def accepted(files: DataFrame) -> DataFrame:
    """A row for each job with its first error, null if it has none."""
    return checked(files).groupBy("job_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"))


def jobs_checked(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """job_id and error (null if none) of jobs (job_id and options): no files, an option that there isn't, the first bad file, or nothing to work on, in this order."""
    own = checked(files)
    usable = F.lower("name").rlike(r"\.(zip|docx)$")
    found = own.groupBy("job_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("bad"), F.count_if(usable).alias("usable"))
    unknown = reduce(lambda a, b: a | b, (~F.coalesce(F.col(k).isin(v), F.lit(False)) for k, v in P.UPLOAD_OPTIONS.items()))
    error = F.when(F.col("usable").isNull(), P.NO_FILES).when(unknown, P.BAD_OPTIONS).when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("usable") == 0, P.NO_INPUT)
    return jobs.join(found, "job_id", "left").select("job_id", error.alias("error"))


def totals(files: DataFrame) -> DataFrame:
    """job_id, how many files of each kind a job has, and their bytes."""
    ends = lambda kind: F.count_if(F.lower("name").endswith(kind))
    return files.groupBy("job_id").agg(F.count("*").alias("n_files"), ends(".zip").alias("n_zip"), ends(".docx").alias("n_docx"), F.sum("size").alias("n_bytes"))


def inputs(files: DataFrame, auto: bool = True) -> DataFrame:
    """job_id, nth, kind, label and n_files of the inputs of each job: zips first, each by itself, then two docx as a pair if ``auto``, else each by itself."""
    name = base(F.col("name"))
    kind = F.when(F.lower(name).endswith(".zip"), "zip").when(is_docx(F.col("name")), "docx")
    f = files.select("job_id", "pos", name.alias("name"), kind.alias("kind")).filter("kind IS NOT NULL")
    f = f.withColumn("n", F.count("*").over(Window.partitionBy("job_id", "kind")))
    together = (F.col("kind") == "docx") & (F.col("n") == 2) & F.lit(auto)
    key = F.when(together, 0).otherwise(F.col("pos"))
    g = f.groupBy("job_id", "kind", key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " + ").alias("label"), F.count("*").cast("int").alias("n_files"))
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("kind"), "key"))
    return g.select("job_id", nth.alias("nth"), "kind", "label", "n_files")


def versions(files: DataFrame) -> DataFrame:
    """job_id, teacher and student (names) from files (job_id, pos, name, size): by words in their names, else the largest is the teacher's."""
    has = lambda words: base(F.col("name")).rlike("|".join(words))
    docx = files.filter(is_docx(F.col("name")))
    row = F.struct("pos", "name")
    d = docx.groupBy("job_id").agg(
        F.min(F.when(has(P.TEACHER_WORDS), row)).alias("t"), F.array_sort(F.collect_list(F.when(has(P.STUDENT_WORDS), row))).alias("students"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "pos", "name"))), lambda x: x["name"]).alias("by_size"),
    )
    student = F.get(F.filter("students", lambda s: F.col("t").isNull() | (s["pos"] != F.col("t.pos"))), F.lit(0))["name"]
    d = d.withColumns({"s": student, "teacher": F.coalesce("t.name", F.get("by_size", F.lit(0)))})
    return d.select("job_id", "teacher", F.coalesce("s", F.get(F.filter("by_size", lambda n: n != F.col("teacher")), F.lit(0))).alias("student"))
