"""Line dedup by overlapping three-line windows.

Every window of three consecutive lines is hashed (128 bits). Windows whose hash occurs more than once are found by a
count that is summed before it is shuffled; their first occurrence, in the order of doc_id and line, stays and the lines
under the later ones go. A line that a first occurrence of a repeated window also covers stays, so that no passage is
lost with all its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_safe_join, table, written

WINDOW = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that repeat both doc_id and text are one document: its key is doc_id and a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key and gone (a sorted array of line numbers from 0) for each document that loses lines."""
    lines = _keyed(docs.filter(F.col("text").isNotNull()))
    # outer, as the filter that explode brings would be pushed below the split and split the text anew for each line
    at = F.expr(f"transform(sequence(0, greatest(size(lines) - {window}, 0)), i -> struct(i AS at, unhex(md5(cast(array_join(slice(lines, i + 1, {window}), '\\n') AS binary))) AS hash))")
    windows = written(lines.filter(F.size("lines") >= window).select("doc_id", "text_key", F.explode_outer(at).alias("w")).select("doc_id", "text_key", "w.*"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "at")
    repeated = written(windows.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("hash", "first"), "repeated")
    found = windows.join(repeated, "hash").select("doc_id", "text_key", "at", (place == F.col("first")).alias("stays"))
    covered = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.when(F.col("stays"), F.col("at"))).alias("first"), F.collect_set(F.when(~F.col("stays"), F.col("at"))).alias("later"))
    spread = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda i: F.sequence(i, i + window - 1))))
    gone = F.array_sort(F.array_except(spread(F.col("later")), spread(F.col("first"))))
    return covered.select("doc_id", "text_key", gone.alias("gone")).filter(F.size("gone") > 0)


def left(lines: Column) -> Column:
    """The lines whose numbers aren't in ``gone``. The numbers are told apart by hashing, so that long texts take no longer than in proportion."""
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the text of documents that lose lines rewritten; all rows and columns stay, whatever their names.

    Lines are what newlines part; texts of fewer lines than a window, empty and null texts stay as they are, and a text
    that loses all its lines becomes empty. Rows that repeat both doc_id and text are one document.
    """
    gone = written(covered_lines(docs, window), "gone")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("text_key"))
    joined = null_safe_join(row, gone.hint("merge"), ["doc_id", "text_key"], "left")
    joined = joined.withColumn("lines", F.split("row.text", "\n"))  # a column of its own, as it would be split for each line inside the lambda
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left(F.col("lines")), "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines and the numbers (from 0) of the lines that go, for every document, with the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = written(covered_lines(docs), "gone")
    row = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    joined = null_safe_join(row, gone.hint("merge"), ["doc_id", "text_key"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(left(F.col("lines")))
    return joined.select("doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"), F.md5(F.array_join(kept, "\n").cast("binary")).alias("text_md5"))


#: The rows of op9_lines in DuckDB's SQL.
SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, text, place, array_to_string(l[place + 1 : place + 3], chr(10)) AS win FROM (SELECT doc_id, text, l, unnest(range(0, len(l) - 2)) AS place FROM d WHERE len(l) >= 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, place) AS rn, count(*) OVER (PARTITION BY win) AS n FROM h),
c AS (SELECT doc_id, text, unnest([place, place + 1, place + 2]) AS line, rn FROM f WHERE n > 1),
g AS (SELECT doc_id, text, line FROM c GROUP BY ALL HAVING min(rn) > 1),
s AS (SELECT doc_id, text, list(line ORDER BY line) AS gone FROM g GROUP BY ALL)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed,
  md5(array_to_string(list_filter(l, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10))) AS text_md5
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) LEFT JOIN s USING (doc_id, text)
"""
