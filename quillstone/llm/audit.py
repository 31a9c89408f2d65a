"""How five filters interact, audited from a sparse document-term matrix.

Documents are packed into blocks of some megabytes of text. A block becomes a shard of the matrix in CSR form: where each
document's row begins, the words of the row by number, and how often each occurs. Words are first numbered within their
block; the distinct words of all blocks then make one dictionary, whose numbers have no gaps, and each block's words
get its numbers, so that a word crosses the network once for each block that has it and not once for each document.

The row sums of the matrix are the documents' words and its nonzero counts their distinct words: these decide the filters A
and B. The other flags go along with the rows. What an order of filters removes depends only on which filters a document
fails, so that counts by part and set of failed filters (32 of them) are all that the 120 orders are worked out from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import SLICE, slices, table, written

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
#: Thresholds of A (words), B and C (hundredths), and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
#: Bytes of text in a block, words of blocks in a bucket of the dictionary, and bytes of a row group of stored blocks.
BLOCK, WORDS_PER_BUCKET, ROW_GROUP = 6 << 20, 250_000, 16 << 20
_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def without(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


def row_flags(text: bytes) -> int:
    """The filters C and D that a text fails."""
    shouts = 100 * without(text, _CAPITALS) > MOST_CAPITALS * (len(text) - without(text, _CONTINUED))
    return C * shouts + D * (without(text, SIGNS) > 0)


def matrix_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, and their CSR shard, in which words have numbers as they stand there: starts, terms and counts.

    Words are what ASCII white space parts; where it stands at an end, or a text is empty, the split has an empty word.
    """
    split = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    words = split.flatten()
    filled = pc.not_equal(pc.binary_length(words), 0)
    coded = words.filter(filled).dictionary_encode()
    cell, counts = np.unique(row[filled.to_numpy(zero_copy_only=False)].astype(np.int64) << 32 | coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, np.searchsorted(cell >> 32, np.arange(len(texts) + 1)), (cell & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)


def block_type(doc_id: T.DataType) -> T.StructType:
    of = {"block": T.LongType(), "words": T.ArrayType(T.StringType()), "starts": T.BinaryType(), "terms": T.BinaryType(), "counts": T.BinaryType(), "doc_ids": T.ArrayType(doc_id), "parts": T.ArrayType(T.StringType()), "flags": T.ArrayType(T.IntegerType()), "digests": T.ArrayType(T.BinaryType())}
    return T.StructType([T.StructField(k, t) for k, t in of.items()])


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Documents (doc_id, part, text) as rows of the matrix in blocks, in which words have the block's own numbers.

    block: its number. words: its distinct words. starts, terms, counts: the shard. doc_ids, parts, flags (C and D) and
    digests (SHA-256 of the text): by document.
    """
    from pyspark import TaskContext

    kind = block_type(docs.schema["doc_id"].dataType)
    schema = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def row() -> pa.RecordBatch:
            doc_ids, parts, texts = (pa.concat_arrays(c) for c in zip(*held))
            words, *arrays = matrix_rows(texts)
            flags, digests = zip(*facts)
            values = {"block": number, "words": words, **{k: a.tobytes() for k, a in zip(("starts", "terms", "counts"), arrays)}, "doc_ids": doc_ids, "parts": parts, "flags": flags, "digests": digests}
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v], f.type) for f, v in zip(schema, values.values())], schema=schema)

        facts: list[tuple[int, bytes]] = []
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), min(block, SLICE)):
                raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
                facts += [(row_flags(t), hashlib.sha256(t).digest()) for t in raw]
                held.append((batch.column("doc_id").slice(at, len(texts)), batch.column("part").slice(at, len(texts)), texts))
                at, size = at + len(texts), size + sum(map(len, raw))
                if size >= block:
                    yield row()
                    number, held, facts, size = number + 1, [], [], 0
        if held:
            yield row()

    return docs.select("doc_id", "part", "text").mapInArrow(run, kind)


def codes(stored: DataFrame) -> DataFrame:
    """block, at, bucket, nth and, in one row for each word, the word: the dictionary's numbers of the words of ``stored``, within buckets of their hash.

    A word crosses the network once for each block. Numbers follow a word's first row in its bucket, which is why the
    result has to be stored before it is used. A bucket is held by a task at once, some WORDS_PER_BUCKET rows: one word is
    a small share of any block, and so of the rows.
    """
    listed = stored.select("block", F.posexplode("words").alias("at", "word"))
    total = stored.agg(F.sum(F.size("words"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)  # those of a bucket
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        coded = whole.column("word").chunk(0).dictionary_encode()
        index = coded.indices.to_numpy()
        first = np.zeros(len(index), bool)
        first[np.unique(index, return_index=True)[1]] = True
        shown = pc.if_else(pa.array(first), whole.column("word").chunk(0), pa.scalar(None, pa.string()))
        bucket = np.full(len(index), TaskContext.get().partitionId(), np.int32)
        made = pa.Table.from_arrays([whole.column("block"), whole.column("at"), pa.array(bucket), pa.array(index.astype(np.int64)), shown], names=["block", "at", "bucket", "nth", "word"])
        yield from made.to_batches(max_chunksize=100_000)

    from pyspark import TaskContext

    parts = max(8, total // WORDS_PER_BUCKET)
    return listed.repartition(parts, "word").mapInArrow(run, "block long, at int, bucket int, nth long, word string")


def row_counts(starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row sums of a CSR shard, and how many different terms each row has with a count. Terms ascend within rows."""
    first = np.diff(terms, prepend=-1) != 0
    begin = starts[:-1]
    first[begin[begin < len(terms)]] = True  # a row's first term may be the last one of the row before
    row = np.repeat(np.arange(len(begin)), np.diff(starts))
    total = lambda x: np.bincount(row, x, len(begin)).astype(np.int64)
    return total(counts), total(first & (counts > 0))


def coded_blocks(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``docs`` (doc_id, part, text), stored, and their words with the dictionary's numbers: block, at, term and, where it is first, word."""
    stored = written(blocks(docs, block), "blocks", row_group=ROW_GROUP)
    coded = written(codes(stored), "codes", row_group=ROW_GROUP)
    # a row for each bucket, of which there is one for so many words
    buckets = coded.groupBy("bucket").agg((F.max("nth") + 1).alias("n"))
    offsets = written(buckets.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before")), "offsets")
    return stored, coded.join(offsets, "bucket").select("block", "at", (F.col("before") + F.col("nth")).alias("term"), "word")


def recoded(stored: DataFrame, coded: DataFrame, kind: T.StructType, finish: Callable[[dict], dict]) -> DataFrame:
    """A row or more for each block: what ``finish`` makes, column by column, of its shard with the dictionary's numbers."""
    schema = to_arrow_schema(kind)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.zeros(len(right), np.int64)
        own[right.column("at").to_numpy()] = right.column("term").to_numpy()
        row = {c: left.column(c)[0] for c in left.column_names}
        starts, local, counts = (np.frombuffer(row[c].as_buffer(), k) for c, k in (("starts", np.int64), ("terms", np.int32), ("counts", np.int32)))
        terms = own[local]
        order = np.lexsort((terms, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
        made = finish(row | {"starts": starts, "terms": terms[order], "counts": counts[order]})
        return pa.Table.from_arrays([made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return stored.drop("words").groupBy("block").cogroup(coded.select("block", "at", "term").groupBy("block")).applyInArrow(run, kind)


def document_term_matrix(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The matrix of ``docs`` (doc_id, part, text) in CSR shards, and its dictionary (word, term).

    A shard is a row as of ``blocks`` without its words: terms are numbers of the dictionary (64 bits), sorted within rows.
    """
    stored, coded = coded_blocks(docs, block)

    def shard(row: dict) -> dict:
        return {k: [v.tobytes() if isinstance(v, np.ndarray) else v.as_py()] for k, v in row.items()}

    return recoded(stored, coded, T.StructType([f for f in stored.schema if f.name != "words"]), shard), coded.filter("word IS NOT NULL").select("word", "term")


def word_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, part, flags (C, D), digest, n_words (the sum of the document's row in the matrix) and n_distinct (its nonzero counts)."""
    stored, coded = coded_blocks(docs, block)
    own = {"doc_id": "doc_ids", "part": "parts", "flags": "flags", "digest": "digests"}
    kind = T.StructType([*(T.StructField(c, stored.schema[k].dataType.elementType) for c, k in own.items()), T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def counted(row: dict) -> dict:
        sums, filled = row_counts(row["starts"], row["terms"], row["counts"])
        return {**{c: row[k].values for c, k in own.items()}, "n_words": sums, "n_distinct": filled}

    return recoded(stored, coded, kind, counted)


def failures(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """part, mask (the filters failed, A the lowest bit) and how many documents: n, good and toxic."""
    rows = word_counts(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text"), block)
    short, poor = F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")
    mask = F.col("flags") + F.when(short, A).otherwise(0) + F.when(poor, B).otherwise(0)
    # copies meet as counts: first rows of one document, then a text's documents of equal part and labels
    counted = rows.groupBy("digest", "part", "doc_id", mask.alias("mask")).agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    marked = counted.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    alike = ["part", "mask", "quality", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = marked.groupBy("digest", *alike).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    groups = groups.withColumn("copies", F.col("n") - F.col("unnumbered") - firsts)
    both = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + E).alias("mask"), F.col("copies").alias("n")))
    each = groups.select("part", "quality", "toxic", F.explode(both).alias("x")).select("part", "quality", "toxic", "x.*")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias({"quality": "good"}.get(c, c))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality"), of("toxic"))


def steps() -> list[dict]:
    """filter_order, step, the step's filter and those before it as bits, for all orders."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [{"filter_order": "".join(o), "step": k + 1, "own": bit[o[k]], "before": sum(bit[f] for f in o[:k])} for o in permutations(FILTERS) for k in range(len(FILTERS))]


def audited(failed: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step does, from counts by part and mask as of ``failures``."""
    listed = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    every = F.explode(listed)
    x = failed.select("*", every.alias("s")).select(*failed.columns, "s.*")
    mask, own, before = F.col("mask"), F.col("own"), F.col("before")
    fails, earlier = mask.bitwiseAND(own) != 0, mask.bitwiseAND(before) != 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0))
    # of the orders of a set of filters that a document fails, each filter comes first in an equal share
    share = F.when(fails, F.col("n") * (F.lit(120) / F.greatest(F.lit(1), F.bit_count(mask))).cast("long")).otherwise(0)
    columns: dict[str, Column] = {
        "kept": total(~fails & ~earlier), "removed": total(fails & ~earlier), "redundant": total(fails & earlier), "unique_fails": total(mask == own),
        "good_lost": total(fails & ~earlier, "good"), "toxic_lost": total(fails & ~earlier, "toxic"), "shapley": F.sum(share),
    }
    return x.groupBy("part", "filter_order", "step").agg(*(c.cast("long").alias(k) for k, c in columns.items()))


def filter_audit(docs: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    docs: doc_id, text and source; labels: doc_id, quality and toxic; other columns are not read, whatever their names. A
    null text is empty, a null source the part ''. A document without doc_id has no smaller one and is none; it fails E
    never and has no labels. Of repeated labels of a document any 1 counts. Repeated rows count each; E compares doc_ids
    alone, so that rows that repeat the least one all stay. A text of any length is one row of the matrix, in a block of
    its own where it is longer than ``block``. An empty table has no parts and so no rows.
    """
    return audited(failures(docs, labels, block))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rows of op13_audit in DuckDB's SQL.
SQL = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
m AS (SELECT part, t, doc_id, CASE WHEN len(l) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(l)) < {LEAST_DISTINCT} * len(l) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN k USING (doc_id) GROUP BY ALL),
s AS (SELECT * FROM (VALUES {", ".join(f"('{s['filter_order']}', {s['step']}, {s['own']}, {s['before']})" for s in steps())}) v(filter_order, step, own, before)),
x AS (SELECT *, mask & own <> 0 AS fails, mask & before <> 0 AS earlier FROM f, s)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
