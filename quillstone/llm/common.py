"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the session's checkpoint folder.

    Where there is neither, a session that runs in this process alone (master local) gets a temporary one; a cluster has to name one.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, row_group: int | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again: the lineage ends here.

    A plan that reads it may run long after, so nothing here removes it: whoever owns the folder empties it between jobs.
    row_group: bytes of a row group, for tables of large rows, of which a reader holds a row group at a time; they are
    compressed harder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group).option("compression", "zstd")
    writer.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that are Python objects at the same time in a task (one text at least).
SLICE = 1 << 20


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """An array of texts in parts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def add_columns(df: DataFrame, read: str, fields: list[T.StructField], rows: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """Appends columns that ``rows`` makes from lists of values of the text column ``read``.

    Only that column goes to Python and only the new ones come back; the rest of a row stays in the JVM. The function
    counts as nondeterministic so that no filter behind it makes Spark call it twice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    new = to_arrow_schema(T.StructType(fields))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            parts = []
            for part in slices(texts):
                made = list(rows(part.to_pylist()))
                parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), new)], fields=list(new)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(new)))

    made = F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, made(F.col(f"`{read}`")).alias("_made")).select(*kept, *(F.col(f"_made.`{f.name}`").alias(f.name) for f in fields))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which a null key equals a null key; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return left.join(other, on, how).drop(*(f"{k}__r" for k in keys))
