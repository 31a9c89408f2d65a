"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

It counts as part of the training-data subpackage and fails to import without it. All stages but the last keep the columns of
documents, whatever others there are and whatever their names. Nulls, ties, repeated rows and empty tables: see each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import shared_dir, table
from quillstone.llm.decontaminate import decontaminate
from quillstone.llm.lines import dedup_lines
from quillstone.llm.quality import keep_good
from quillstone.llm.sentencepieces import encoded
from quillstone.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null and empty texts among them. Null lang or source is a group; repeated rows fare alike."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go from the texts, by doc_id (null last). All rows stay; rows that repeat doc_id and text are one document."""
    return dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays, that with the least doc_id (null last); of rows that repeat it and its text, one. Texts without words are alike."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go. Null texts have none; null items and an empty benchmark hit nothing; repeated rows fare alike."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with the scores of its best segmentations; a null text has no ids. All rows stay."""
    return encoded(docs).select("doc_id", "ids", "scores", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Python and learned vocabularies take part in the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
