"""Likeness of vectors to templates: the best category of each vector."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Templates that a task compares a vector with at once.
BLOCK = 256


def scored(vectors: pa.Array, categories: np.ndarray, templates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the best category and its likeness: the cosine, between 0 and 1 and to six digits; of equal ones the first category. Null and zero vectors are like nothing."""
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    rows = np.zeros((len(vectors), templates.shape[1]))
    rows[known] = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    likeness = np.round(np.clip(np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0) @ templates.T, 0, 1), 6)
    best = likeness.argmax(1)
    return categories[best], likeness[np.arange(len(rows)), best]


def one_pass(categories: np.ndarray, templates: np.ndarray):
    """A function of a column of vectors: similarity, and rank, the greater the earlier the category."""
    norms = np.linalg.norm(templates, axis=1, keepdims=True)
    unit = np.divide(templates, norms, out=np.zeros_like(templates), where=norms > 0)

    def run(vectors: pa.Array) -> pa.Array:
        category, similarity = scored(vectors, categories, unit)
        return pa.StructArray.from_arrays([pa.array(similarity, pa.float64()), pa.array(-category, pa.int32())], ["similarity", "rank"])

    return F.arrow_udf(run, "similarity double, rank int")


def best_category(vectors: DataFrame, templates: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vectors`` (embedding and whatever else) with category and similarity of the most like of ``templates`` (category, template).

    Templates come to the driver a block at a time, in the order of their categories, and are handed to one pass over the
    vectors, normalised once; no more than a block of them is ever held or shipped. All vectors have the length of the templates.
    """
    rows = ((r.category, r.template) for r in templates.orderBy("category").toLocalIterator())
    passes = []
    while part := list(islice(rows, block)):
        passes.append(one_pass(np.array([c for c, _ in part]), np.array([t for _, t in part], np.float64))("embedding"))
    if not passes:
        return vectors.withColumns({"category": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double")}).limit(0)
    each = vectors.withColumns({f"_{k}": p for k, p in enumerate(passes)})
    best = reduce(lambda a, b: F.greatest(a, b), (F.col(f"_{k}") for k in range(len(passes))))
    return each.withColumn("_best", best).select(*vectors.columns, (-F.col("_best.rank")).alias("category"), F.col("_best.similarity").alias("similarity"))
