"""Suffix-array dedup with sparse suffix arrays.

Of each text's word suffixes only those are kept that begin at content-selected places: the minimisers of windows of
fifty words, taken over hashes of sixteen. Any two texts that share fifty words also share the minimiser in them. The
suffixes are sorted over the cluster and compared with their neighbours: those that begin alike are candidates. Around each
candidate the match is extended left and right, over all fifty-word windows whose minimiser it is; these are sorted and
compared with their neighbours in turn, and the places that repeated windows cover merge into spans. The first occurrence of
each window stays, and what later ones cover is to go.

A neighbour in the order of suffixes only tells how far a match goes to the right of it. A passage may go on to the left
with one text and to the right with another, so neighbours are compared by hashes (of sixteen and of fifty words) that are
equal where the words are, and every text that has a window is found, not the next one alone. The sorts deal rows out by
ranges of (hash, document), so a passage that a third of all documents share is spread over many tasks; the first and last
row of every task are compared with those of the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, slices, table, written

#: Words of a repeat, and of the hash that minimisers are taken over (a power of two).
REPEAT, GRAM = 50, 16
VOCABULARY = 200_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of words, each word once as long as it is remembered: until there are more than ``most``."""

    def __init__(self, most: int = VOCABULARY):
        self.ids: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.ids) > self.most:
            self.ids.clear()
        out, ids = [], self.ids
        for w in words:
            h = ids.get(w)
            if h is None:
                h = ids[w] = xxh64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def doubled(h: np.ndarray, to: int, op) -> np.ndarray:
    """op over all runs of ``to`` items, by runs of twice the length each time; op must not mind overlaps."""
    n = 1
    while 2 * n <= to:
        h = op(h[:-n], h[n:])
        n *= 2
    return op(h[: len(h) - (to - n)], h[to - n :]) if to > n else h


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, from the words' hashes: runs whose lengths are the powers of two in n, one after the other."""
    count, out, done, size = len(h) - n + 1, None, 0, 1
    while True:
        if n & size:
            part = h[done : done + count]
            out = part if out is None else mixed(out * _C1 + part)
            done += size
        if 2 * size > n:
            return out
        h = mixed(h[:-size] * _C1 + h[size:])
        size *= 2


def minimisers(g: np.ndarray, span: int, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``span`` hashes their least one; and the positions of all least ones. Windows that aren't ``whole`` have nought."""
    least = doubled(g, span, np.minimum)
    if whole is not None:
        least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return least, np.flatnonzero(doubled(padded, span, np.maximum) == g)


class Slice:
    """Some documents as one array of words' hashes, so that arrays are long however short the texts are."""

    def __init__(self, texts: list[str], word_hashes: Hashes, repeat: int):
        each = [word_hashes(WORD.findall(t)) for t in texts]
        size = np.array([len(h) for h in each], np.int64)
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        self.begin = np.cumsum(size) - size
        #: The document of each word, and whether a window of ``repeat`` words that begins there ends in it.
        self.doc = np.repeat(np.arange(len(size)), size)
        n = max(0, len(self.hashes) - repeat + 1)
        self.whole = self.doc[:n] == self.doc[len(self.doc) - n :]

    def any(self) -> bool:
        return bool(self.whole.any())


ORDER = ["hash", "none", "doc_id", "doc"]


def neighbours(rows: DataFrame, within: bool = False) -> DataFrame:
    """The rows of (hash, none, doc_id, doc, n, at) whose hash another document has too, or, if ``within``, that stand for more than one place (n) of their document.

    ``first`` tells the document that comes first: by doc_id, nulls (none) last. Rows that repeat (hash, doc) count as one;
    one of them stays at least. rows: a written table, as the deal by ranges reads it twice.
    """
    names = [*ORDER, "n", "at", "state"]

    def run(batches):
        # state: 1 a hash that another document has, 2 an end of a task, 4 the first row of its hash
        before, held, begins = None, None, True

        def out(b, keep, state):
            return pa.RecordBatch.from_arrays([*b.take(pa.array(keep)).columns, pa.array(state)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            # the last row is held back until the next one is known
            b = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            h, d, own = np.asarray(b.column(0)), np.asarray(b.column(3)), (np.asarray(b.column(4)) > 1) & within
            # neighbours that begin alike in two documents; the places of one document are in one row
            alike = np.append(before is not None and before[0] == h[0], h[1:] == h[:-1])
            other = alike & np.append(before is not None and before[1] != d[0], d[1:] != d[:-1])
            state = (other | np.append(other[1:], False) | own).astype(np.int8) | np.where(alike, 0, 4).astype(np.int8)
            state[0] |= 2 * begins
            if len(h) > 1:
                keep = np.flatnonzero(state[:-1] & 3)
                yield out(b, keep, state[keep])
                before, begins = (h[-2], d[-2]), False
            held = b.slice(len(h) - 1)
        if held is not None:
            h, d, n = held.column(0)[0].as_py(), held.column(3)[0].as_py(), held.column(4)[0].as_py()
            alike = before is not None and before[0] == h
            yield out(held, [0], np.array([2 | (alike and before[1] != d or n > 1 and within) | (0 if alike else 4)], np.int8))

    kind = rows.schema["at"].dataType.simpleString()
    order = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select(*names[:-1])
    found = written(order.mapInArrow(run, f"hash long, none boolean, doc_id long, doc long, n int, at {kind}, state byte"), "neighbours")
    place = F.struct("none", "doc_id", "doc")
    sure = found.filter("state & 3 = 1").select("hash", "doc_id", "doc", "at", (F.col("state").bitwiseAND(4) > 0).alias("first"))
    # a row at either end of a task: its neighbour is an end of another task
    ends = found.filter("state & 2 = 2")
    by_hash = ends.groupBy("hash").agg(F.countDistinct("doc").alias("docs"), F.min(place).alias("least"))
    end = ends.join(by_hash, "hash").filter("state & 1 = 1 OR docs > 1")
    first = (F.col("state").bitwiseAND(4) > 0) & (place == F.col("least"))
    return sure.unionByName(end.select("hash", "doc_id", "doc", "at", first.alias("first")))


def _docs(docs: DataFrame) -> DataFrame:
    """Rows that repeat both doc_id and text are one document."""
    return docs.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("doc"), F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text")


def _spread(rows: DataFrame, fields: str, made) -> DataFrame:
    """Rows of hash, none, doc_id, doc and ``fields`` that ``made`` gives for parts of an Arrow batch of rows (doc, none, doc_id, text, ...), as (index of the row, columns)."""
    def run(batches):
        for b in batches:
            at = 0
            for part in slices(b.column(3)):
                rows = b.slice(at, len(part))
                at += len(part)
                found = made(part.to_pylist(), rows)
                if found is not None:
                    owner, key, *columns = found
                    owner = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(rows.column(k).take(owner) for k in (1, 2, 0)), *columns], names=[*ORDER, *(f.split()[0] for f in fields.split(", "))])

    return rows.mapInArrow(run, f"hash long, none boolean, doc_id long, doc long, {fields}")


def suffixes(docs: DataFrame, repeat: int, gram: int) -> DataFrame:
    """(hash, none, doc_id, doc, n, at): the sparse suffixes of each document, by the hash of their first words, with the number of their places and the first."""
    word_hashes = Hashes()

    def made(texts, rows):
        s = Slice(texts, word_hashes, repeat)
        if not s.any():
            return None
        g = grams(s.hashes, gram)
        _, place = minimisers(g, repeat - gram + 1, s.whole)
        g, doc = g[place], s.doc[place]
        order = np.lexsort((place, g, doc))
        g, doc, place = g[order], doc[order], place[order]
        cut = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
        count = np.diff(np.append(cut, len(g)))
        return doc[cut], g[cut], pa.array(count.astype(np.int32)), pa.array((place[cut] - s.begin[doc[cut]]).astype(np.int32))

    return _spread(docs.select("doc", "none", "doc_id", "text"), "n int, at int", made)


def windows(candidates: DataFrame, repeat: int, gram: int) -> DataFrame:
    """(hash, none, doc_id, doc, n, at): windows of ``repeat`` words about the candidates. candidates: with near (hashes of suffixes). at: all n places of the window."""
    word_hashes = Hashes()

    def made(texts, rows):
        s = Slice(texts, word_hashes, repeat)
        near = rows.column(4)
        known, rank = np.unique(np.asarray(near.flatten()).view(np.uint64), return_inverse=True)
        if not s.any() or not len(known):
            return None
        least, _ = minimisers(grams(s.hashes, gram), repeat - gram + 1, s.whole)
        owner = np.repeat(np.arange(len(near)), np.asarray(near.value_lengths()))
        place = np.minimum(np.searchsorted(known, least), len(known) - 1)
        at = np.flatnonzero(s.whole & (known[place] == least))
        at = at[np.isin(s.doc[at] * len(known) + place[at], owner * len(known) + rank)]
        if not len(at):
            return None
        key, doc = grams(s.hashes, repeat)[at], s.doc[at]
        order = np.lexsort((at, key, doc))
        key, doc, at = key[order], doc[order], (at - s.begin[doc])[order].astype(np.int32)
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        ends = np.append(cut, len(at)).astype(np.int32)
        return doc[cut], key[cut], pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at))

    return _spread(candidates.select("doc", "none", "doc_id", "text", "near"), "n int, at array<int>", made)


SPANS = "array<struct<at:int,n_words:int>>"


def _merged(at: np.ndarray, repeat: int) -> np.ndarray:
    """Rows (begin, end) of what windows that begin at sorted places cover."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    new = np.append(True, np.diff(at) > repeat)
    return np.stack([at[new], at[np.append(new[1:], True)] + repeat], 1)


def _without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (begin, end) of what the spans ``a`` cover and ``b`` don't; both are sorted and none of their own meet."""
    edges = np.concatenate([a.ravel(), b.ravel()])
    step = np.concatenate([np.tile([1, -1], len(a)), np.tile([-2, 2], len(b))])
    order = np.argsort(edges, kind="stable")
    edges, level = edges[order], np.cumsum(step[order])
    inside = (level[:-1] == 1) & (edges[1:] > edges[:-1])
    begin, end = edges[:-1][inside], edges[1:][inside]
    new = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    return np.stack([begin[new], end[np.append(new[1:], True)[: len(end)]]], 1)


def repeated_spans(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, within: bool = False) -> DataFrame:
    """(doc_id, doc, spans, gone): for documents that share ``repeat`` words in a row with another, the merged spans (at, n_words) of such passages.

    With ``within``, words that a document has at two places of its own (they may overlap) are repeats too. gone: the
    spans that dedup takes out. Of the places of a window the first stays, that of the least doc_id (null last) and in it
    the first; what later places cover goes, but for words that are also in a place that stays.

    Words are as in the text, their case included; spans count words from 0. Documents with no repeat, with fewer words
    than one, or with a null text give no row. Rows that repeat both doc_id and text are one document and give one row;
    their places are no repeats of each other. Texts of any length are read whole. Other columns of ``docs`` are neither
    read nor returned.
    """
    keyed = _docs(docs)
    alike = neighbours(written(suffixes(keyed, repeat, gram), "suffixes"), within)
    near = written(alike.groupBy("doc").agg(F.collect_set("hash").alias("near")), "near")
    shared = neighbours(written(windows(keyed.join(near.hint("merge"), "doc"), repeat, gram), "windows"), within)
    # the first place of a window in the first document that has it stays
    stays, later = F.when(F.col("first"), F.slice("at", 1, 1)).otherwise(F.array().cast("array<int>")), F.when(F.col("first"), F.expr("slice(at, 2, size(at))")).otherwise(F.col("at"))
    places = shared.groupBy("doc", "doc_id").agg(F.flatten(F.collect_list(stays)).alias("stays"), F.flatten(F.collect_list(later)).alias("later"))
    kind = T._parse_datatype_string(f"doc long, doc_id long, spans {SPANS}, gone {SPANS}")

    def run(batches):
        arrow = pa.list_(pa.struct([("at", pa.int32()), ("n_words", pa.int32())]))
        for b in batches:
            spans, gone = [], []
            for stay, late in zip(b.column(2), b.column(3)):
                stay, late = (np.unique(np.asarray(x.values)).astype(np.int64) for x in (stay, late))
                spans.append(_merged(np.union1d(stay, late), repeat))
                gone.append(_without(_merged(late, repeat), _merged(stay, repeat)))
            made = [pa.array([[{"at": int(x), "n_words": int(y - x)} for x, y in s] for s in both], arrow) for both in (spans, gone)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc", "doc_id", "spans", "gone"])

    found = places.mapInArrow(run, kind)
    return found.join(keyed.filter("none").select("doc").distinct().withColumn("none", F.lit(True)), "doc", "left").select(F.when(F.col("none").isNull(), F.col("doc_id")).alias("doc_id"), "doc", "spans", "gone")


def without_words(text: str, gone: list) -> str:
    """A text without the words of spans (at, n_words), each with the white space behind it."""
    if not gone:
        return text
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for s in gone:
        out.append(text[at : starts[s["at"]]])
        at = starts[s["at"] + s["n_words"]]
    return "".join([*out, text[at:]])


def dedup_suffixes(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, within: bool = True) -> DataFrame:
    """``docs`` with the words of later occurrences of repeated passages taken out; all rows and columns stay, whatever their names.

    Null and empty texts stay as they are, and a text all of whose words go keeps the white space before its first one.
    """
    gone = written(repeated_spans(docs.select("doc_id", "text"), repeat, gram, within).filter(F.size("gone") > 0).select("doc", "gone"), "gone")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text")).alias("doc"))

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if g is None else without_words(t, g) for t, g in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    cut = F.arrow_udf(run, "string")
    joined = row.join(gone.hint("merge"), "doc", "left")
    text = cut("row.text", "gone")
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_spans, n_repeated_words, longest, the spans as text, n_gone_words and the spans that dedup takes out, for documents with repeats, across documents or within one."""
    found = repeated_spans(table(spark, sf_dir, "documents"), within=True)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["at"].cast("string"), s["n_words"].cast("string"))), ",")
    longest = F.array_max(F.transform("spans", lambda s: s["n_words"])).cast("long")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), total("spans").alias("n_repeated_words"), longest.alias("longest"), text("spans").alias("spans"), total("gone").alias("n_gone_words"), text("gone").alias("gone"))
