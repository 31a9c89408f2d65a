"""Quality rules whose thresholds come from the corpus itself.

Every document gets counts from its whole text. For each language and source two measures go into mergeable quantile
sketches: histograms over log-linear buckets (exact below 64, within 1/32 above), whose merge is the sum of counts, so that
the order of merging never matters. The measures are the mean length of a word and the share of punctuation; prose has some
of either everywhere, so that their quartiles tell how far good texts lie apart. A group's sketch is blended with that of
its language, and a language's with that of the whole corpus, which counts as PRIOR documents: a group of few documents
follows its language and a large one itself, with no switch between. A measure is rejected beyond FENCE quartile distances
from the quartiles of the blended sketch; the distance is the widest of the group's, its language's and the corpus's, as
copies of one text can narrow a group's. The verdict is a join of the documents with the table of fences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, add_columns, table, written

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks"]
#: Measures, as integers, so that every engine agrees on them.
MEASURES = {"word_length": "(100 * word_chars) div greatest(n_words, 1L)", "marks": "(1000 * n_marks) div greatest(word_chars, 1L)"}
#: Only word length can be too low.
TWO_SIDED = ["word_length"]
FENCE, PRIOR = 6, 200
#: Parts of a document that blended sketches count in.
PARTS = 64
#: ASCII punctuation and symbols.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    rank, v = a[:n], len(ids)
    for k in range(1, window):
        if int(rank.max() + 1) * v >= 2**62:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * v + a[k : k + n]
    _, inverse, count = np.unique(rank, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    seen: set[str] = set()
    dup = 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    coded = text.encode("utf-8", "replace")
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, "#*$%&|<>")), dup, repeated_words(words), len(coded) - len(coded.translate(None, MARKS))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``_counts`` (a struct of COUNTS)."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return add_columns(docs, "text", [T.StructField("_counts", kind)], lambda texts: ((dict(zip(COUNTS, text_counts(t))),) for t in texts))


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def bucket(v: Column) -> Column:
    """The log-linear bucket of a count: the number itself below 64, then 32 buckets for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", v, shift)).cast("long")


def quartiles(sketch: DataFrame, key: list[str]) -> DataFrame:
    """key, measure, q1 and q3 (the outer ends of their buckets) and their distance, a bucket's width at least. sketch: key, measure, bucket, n."""
    w = Window.partitionBy(*key, "measure")
    cum = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    shift = "greatest(bucket div 32 - 1, 0L)"
    low, high = F.expr(f"shiftleft(bucket - 32 * ({shift}), int({shift}))"), F.expr(f"shiftleft(bucket - 32 * ({shift}) + 1, int({shift})) - 1")
    ends = cum.groupBy(*key, "measure").agg(F.min(F.when(4 * F.col("upto") >= F.col("total"), low)).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), high)).alias("q3"))
    return ends.withColumn("distance", F.col("q3") - F.col("q1") + 1)


def blended(own: DataFrame, parent: DataFrame, key: list[str], above: list[str], prior: int) -> DataFrame:
    """The sketches of ``own`` (key, measure, bucket, n) with that of the parent (above, measure, bucket, n), which counts as ``prior`` documents."""
    parent = parent.withColumn("all", F.sum("n").over(Window.partitionBy(*above, "measure")))
    support = own.select(*key, "measure").distinct().join(parent, [*above, "measure"])
    mine = own.withColumnRenamed("n", "own")
    n = PARTS * F.coalesce("own", F.lit(0)) + F.expr(f"({prior * PARTS}L * n) div all")
    return support.join(mine, [*key, "measure", "bucket"], "left").select(*key, "measure", "bucket", n.alias("n"))


def fences(counted: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """A row for each lang and source with a map from measure to its fence. counted: every document's lang, source and COUNTS.

    Documents that already fail the base rule don't enter the sketches; a group in which all fail has no fence.
    """
    points = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.expr(e)).alias("bucket")) for m, e in MEASURES.items())))
    counts = counted.withColumn("p", points).filter(~base_failed()).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count("*").alias("n"))
    sketch = written(counts, "sketch")
    merged = lambda key: sketch.groupBy(*key, "measure", "bucket").agg(F.sum("n").alias("n"))
    every = written(merged([]), "sketch")
    by_lang = written(blended(merged(["lang"]), every, ["lang"], [], prior), "sketch")
    own = quartiles(blended(sketch, by_lang, ["lang", "source"], ["lang"], prior), ["lang", "source"])
    lang_width = quartiles(by_lang, ["lang"]).select("lang", "measure", F.col("distance").alias("d1"))
    all_width = quartiles(every, []).select("measure", F.col("distance").alias("d2"))
    joined = own.join(lang_width, ["lang", "measure"]).join(F.broadcast(all_width), "measure")  # a row for each measure
    reach = fence * F.greatest("distance", "d1", "d2")
    ends = F.struct(F.when(F.col("measure").isin(TWO_SIDED), F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", ends))).alias("fence"))


def inside() -> Column:
    """Whether a document with COUNTS and its group's ``fence`` is inside all its fences (no fence: inside)."""
    tests = []
    for m, e in MEASURES.items():
        end = F.col("fence")[m]
        tests += [F.coalesce(F.expr(e) <= end["high"], F.lit(True)), F.coalesce(F.expr(e) >= end["low"], F.lit(True))]
    return F.reduce(F.array(*tests), F.lit(True), lambda a, b: a & b)


def grouped(docs: DataFrame) -> DataFrame:
    """lang and source as group keys, null counting as a value of its own."""
    return docs.withColumns({c: F.coalesce(F.col(c), F.lit("\u0000null")) for c in ("lang", "source")})


def judged(counted: DataFrame, prior: int, fence: int) -> DataFrame:
    """``counted`` (lang, source and COUNTS among its columns) with base_failed and kept."""
    counted = grouped(counted)
    table_of_fences = written(fences(counted.select("lang", "source", *COUNTS), prior, fence), "fences")
    failed = base_failed()
    return counted.join(table_of_fences, ["lang", "source"], "left").withColumns({"base_failed": failed, "kept": ~failed & inside()})


def quality(docs: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and n_marks, a row for each row of ``docs`` (doc_id, text, lang, source).

    A null text counts as empty; null lang or source is a group of its own; repeated rows are judged alike; an empty
    table gives an empty result; a text of any length is read whole. Other columns of ``docs`` are neither read nor returned.
    """
    counted = written(with_counts(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "_counts.*"), "counts")
    return judged(counted, prior, fence).select("doc_id", *COUNTS[:5], "base_failed", "kept", "n_marks")


def keep_good(docs: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, whatever their names.

    Rows are written with their counts, so that texts go to Python once.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text", "lang", "source")
    counted = written(with_counts(packed).select("row", "lang", "source", "_counts.*"), "counted")
    return judged(counted, prior, fence).filter("kept").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The rows of op2_quality in DuckDB's SQL: histograms, quartiles and fences are integers there too."""
    space = r"[\x20\x09-\x0D]"
    measures = ", ".join(f"{{'measure': '{m}', 'v': {e.replace(' div ', ' // ').replace('1L', '1')}}}" for m, e in MEASURES.items())
    two = ", ".join(f"'{m}'" for m in TWO_SIDED)

    def quartiles_sql(sketch: str, keys: str) -> str:
        by = ", ".join(filter(None, [keys, "measure"]))
        return f"""(SELECT *, q3 - q1 + 1 AS distance FROM (
  SELECT {by}, min(CASE WHEN 4 * upto >= total THEN (bucket - 32 * s) << s END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN ((bucket - 32 * s + 1) << s) - 1 END) AS q3 FROM (
    SELECT {by}, bucket, CAST(greatest(bucket // 32 - 1, 0) AS BIGINT) AS s, CAST(sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY {by}) AS BIGINT) AS total FROM {sketch})
  GROUP BY {by}))"""

    def blended_sql(own: str, parent: str, keys: list[str], above: list[str]) -> str:
        join, using = ("JOIN", f"USING ({', '.join(above)})") if above else ("CROSS JOIN", "")
        return f"""(SELECT {", ".join(f"g.{k}" for k in keys)}, p.measure, p.bucket, CAST({PARTS} * coalesce(o.n, 0) + ({PRIOR * PARTS} * p.n) // p.total AS BIGINT) AS n
  FROM (SELECT DISTINCT {", ".join(keys)} FROM {own}) g {join} (SELECT *, CAST(sum(n) OVER (PARTITION BY {", ".join([*above, "measure"])}) AS BIGINT) AS total FROM {parent}) p {using}
  LEFT JOIN {own} o ON {" AND ".join(f"o.{k} = g.{k}" for k in keys)} AND o.measure = p.measure AND o.bucket = p.bucket)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1) || 'null') AS lang, coalesce(source, chr(1) || 'null') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT rid, k, array_to_string(ws[k : k + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS k FROM w WHERE len(ws) > {WINDOW})),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(k, k + {WINDOW})) AS p FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(length(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g')) AS BIGINT) AS n_marks FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
p AS (SELECT rid, lang, source, base_failed, m.measure AS measure, CAST(m.v AS BIGINT) AS v FROM (SELECT rid, lang, source, base_failed, unnest([{measures}]) AS m FROM f)),
sketch AS (SELECT lang, source, measure, 32 * greatest(length(bin(v)) - 6, 0) + (v >> greatest(length(bin(v)) - 6, 0)) AS bucket, count(*) AS n FROM p WHERE NOT base_failed GROUP BY ALL),
every AS (SELECT measure, bucket, CAST(sum(n) AS BIGINT) AS n FROM sketch GROUP BY ALL), lang_sketch AS (SELECT lang, measure, bucket, CAST(sum(n) AS BIGINT) AS n FROM sketch GROUP BY ALL),
by_lang AS {blended_sql("lang_sketch", "every", ["lang"], [])}, own AS {blended_sql("sketch", "by_lang", ["lang", "source"], ["lang"])},
fence AS (SELECT o.lang, o.source, measure, CASE WHEN measure IN ({two}) THEN o.q1 - {FENCE} * greatest(o.distance, b.distance, e.distance) END AS low, o.q3 + {FENCE} * greatest(o.distance, b.distance, e.distance) AS high
  FROM {quartiles_sql("own", "lang, source")} o JOIN {quartiles_sql("by_lang", "lang")} b USING (lang, measure) JOIN {quartiles_sql("every", "")} e USING (measure)),
v AS (SELECT rid, bool_and(coalesce(v <= high AND v >= coalesce(low, v), true)) AS good FROM p LEFT JOIN fence USING (lang, source, measure) GROUP BY rid)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND good AS kept FROM f JOIN v USING (rid)
"""


SQL = _sql()
