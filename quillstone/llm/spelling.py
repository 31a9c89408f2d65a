"""Spelling variants: words one edit apart, found with an index of grams of variable length.

The gram dictionary has all grams of SHORTEST letters and, of longer ones up to LONGEST, those whose parent, the gram without
its last letter, is frequent: rare grams aren't extended. It follows from the frequent grams alone, of which there are fewer
than FREQUENT of each length whatever the words, as frequent means more than one in FREQUENT of all grams of that length.

A word between an opening and a closing sign is decomposed into the longest gram of the dictionary at each place, without
those that lie inside the one before. One edit at place i affects only grams that have i, and grams behind it that a new gram
could cover, which end before i + LONGEST; the most that any place affects is the word's bound. All other grams keep their
place, counted from the start before the edit and from the end behind it. With a bound of b, the T = grams - b that stay are
shared with every word one edit away; the lists of the T - 1 most frequent grams needn't be read, as one of the b + 1 rarest
is among those shared, on both sides. (T is at least 1 for words of 2 * LONGEST - 2 letters and more.) Lists are merged on
gram and place, what they bring together is verified.

A list of more than LIST words isn't paired off: its words are split again by their patterns, that is what is left and right of
each place, which bring together only words one edit apart.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, table, written

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters and occurrences that a word has at least, how many times more frequent its form is, and one in how many runs loses a letter.
LETTERS, OCCURRENCES, TIMES, MISSPELT = 6, 5, 5, 199
#: Lengths of grams, frequent grams of a length, words that a frequent gram has at least, and words of a list that are paired off.
SHORTEST, LONGEST, FREQUENT, SELDOM, LIST = 2, 4, 4_000, 64, 64
OPENS, CLOSES = "\x02", "\x03"
COUNTED = 8 << 20


def misspelt(runs: Counter, doc_id: object) -> Iterator[tuple[str, int]]:
    """The runs of a document with their counts; those whose checksum MISSPELT divides lose a letter."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if h % MISSPELT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n, how often it occurs in ``docs`` (doc_id, text), for words of ``letters`` and ``occurrences`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = re.compile(RUN.pattern[:-1] + "{%d,}" % letters)  # a shorter run stays too short
        for batch in batches:
            at = 0
            for part in slices(batch.column("text"), COUNTED):
                found: Counter = Counter()
                for doc_id, text in zip(batch.column("doc_id").slice(at, len(part)).to_pylist(), part.cast(pa.binary()).to_pylist()):
                    for word, n in misspelt(Counter(long.findall((text or b"").lower().decode())), doc_id):  # bytes.lower() is for A-Z alone
                        if len(word) >= letters:
                            found[word] += n
                at += len(part)
                yield pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def frequent_grams(listed: DataFrame, frequent: int = FREQUENT, seldom: int = SELDOM) -> dict[str, int]:
    """Grams that more than one in ``frequent`` of their length are, and more than ``seldom``, with their counts: less than ``frequent`` for each length."""
    signed = F.concat(F.lit(OPENS), F.col("word"), F.lit(CLOSES))
    total = listed.agg(F.sum(F.length("word") + 1)).first()[0] or 0  # grams of the least length, the most there are of any
    grams = F.expr(f"flatten(transform(sequence({SHORTEST}, {LONGEST}), q -> transform(sequence(1, length(signed) - q + 1), p -> substring(signed, p, q))))")
    counted = listed.select(signed.alias("signed")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: r.n for r in counted.filter(F.col("n") > max(seldom, total // frequent)).collect()}


def decomposed(word: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Where the grams of a signed word begin and end (behind their last letter). Both ascend."""
    out, covered = [], 0
    for at in range(len(word) - SHORTEST + 1):
        end = at + SHORTEST
        while end < len(word) and end - at < LONGEST and word[at:end] in frequent:
            end += 1
        if end > covered:
            out.append((at, end))
            covered = end
    return out


def affected(grams: list[tuple[int, int]], size: int) -> int:
    """The most grams that one edit of a signed word of ``size`` signs affects."""
    starts, ends = (np.array(x) for x in zip(*grams))
    at = np.arange(1, size)
    reached = np.maximum(np.searchsorted(starts, at, "right"), np.searchsorted(ends, at + LONGEST, "right"))
    return int((reached - np.searchsorted(ends, at, "right")).max())


def keys(word: str, frequent: dict[str, int]) -> list[str]:
    """The lists that a word is in: its rarest grams, one more than an edit affects, by place from the start and from the end."""
    signed = f"{OPENS}{word}{CLOSES}"
    grams = decomposed(signed, frequent)
    ranked = sorted((frequent.get(signed[a:e], 0), signed[a:e], a, e) for a, e in grams)
    return [k for _, gram, a, e in ranked[: affected(grams, len(signed)) + 1] for k in (f"{a}<{gram}", f"{len(signed) - e}>{gram}")]


def patterns(word: str) -> list[tuple[str, int]]:
    """What is left and right of each place of a word, as checksums; role 0: without the letter there, to meet its like; 1: with none lost; 2: as of a word that is shorter by it."""
    left, right = [0], [0]
    for c in word:
        left.append(zlib.crc32(c.encode(), left[-1]))
    for c in reversed(word):
        right.append(zlib.crc32(c.encode(), right[-1]))
    right.reverse()
    size = len(word)
    lost = [f"{i}.{left[i]}.{right[i + 1]}" for i in range(size)]
    return [*((f"={size}.{x}", 0) for x in lost), *((f"-{size}.{i}.{left[i]}.{right[i]}", 1) for i in range(size + 1)), *((f"-{size - 1}.{x}", 2) for x in lost)]


def exploded(listed: DataFrame, made: str, kind: T.DataType, each: Callable[[str], list]) -> DataFrame:
    """``listed`` (word, n) with a row for each element that ``each`` makes from the word."""
    of = pa.list_(to_arrow_type(kind))

    def run(column: pa.Array) -> pa.Array:
        return pa.array([each(w) for w in column.to_pylist()], of)

    return listed.select("word", "n", F.explode(F.arrow_udf(run, T.ArrayType(kind))("word")).alias(made))


def near(listed: DataFrame, frequent: int = FREQUENT, seldom: int = SELDOM, list_size: int = LIST) -> DataFrame:
    """a, a_n, b and b_n, for each two words a < b of ``listed`` (word, n) that are one edit apart."""
    grams = frequent_grams(listed, frequent, seldom)
    postings = written(exploded(listed, "key", T.StringType(), lambda w: keys(w, grams)), "postings")
    long = written(postings.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > list_size), "long_lists")
    side = lambda df, name: df.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), *(c for c in df.columns if c not in ("word", "n")))
    verified = (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    paired_off = postings.join(long, "key", "left_anti")
    short = side(paired_off, "a").join(side(paired_off, "b"), "key").filter((F.col("a") < F.col("b")) & verified)
    crowded = postings.join(long, "key", "left_semi").select("word", "n").distinct()
    role = T.StructType([T.StructField("key", T.StringType()), T.StructField("role", T.IntegerType())])
    split = written(exploded(crowded, "p", role, lambda w: [{"key": k, "role": r} for k, r in patterns(w)]).select("word", "n", "p.*"), "patterns")
    mine, other = side(split, "a"), side(split.withColumnRenamed("role", "other"), "b")
    met = mine.join(other, "key").filter(((F.col("role") == 0) & (F.col("other") == 0) & (F.col("a") < F.col("b"))) | ((F.col("role") == 1) & (F.col("other") == 2)))
    ends = F.when(F.col("a") < F.col("b"), F.struct("a", "a_n", "b", "b_n")).otherwise(F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    from_patterns = met.filter(verified).select(ends.alias("x")).select("x.*")
    return short.select("a", "a_n", "b", "b_n").unionByName(from_patterns).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last word that forms (word, form) lead to. Each round doubles the steps taken; a form is more frequent than its word, so that they end."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, frequent: int = FREQUENT, seldom: int = SELDOM, list_size: int = LIST) -> DataFrame:
    """word, form, root, n, n_near and form_n, a row for each word of ``docs`` (doc_id, text) with enough letters and occurrences.

    form: of the words one edit away the most frequent (of equal ones the least by code points), if it occurs ``times`` as
    often as the word; form_n: how often. Null texts have no words; a null doc_id is written as nothing before the colon.
    Repeated rows count each. A word may be of any length. An empty table has no words. Other columns are not read.
    letters: 2 * LONGEST - 2 at least.
    """
    if letters < 2 * LONGEST - 2:
        raise ValueError("shorter words have no gram that an edit leaves")
    listed = written(words(docs, letters, occurrences), "words")
    pairs = written(near(listed, frequent, seldom, list_size), "near")
    both = pairs.select(F.col("a").alias("word"), "b", "b_n").unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("rank"), F.col("b").alias("form"))).alias("best"))
    counted = listed.join(best, "word", "left")
    enough = -F.col("best.rank") >= times * F.col("n")
    formed = written(counted.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.rank")).alias("form_n")), "formed")
    last = roots(formed.filter("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
