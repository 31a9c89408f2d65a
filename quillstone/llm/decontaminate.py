"""Benchmark decontamination over suffix arrays of the training texts.

Each task gathers its documents into shards of bounded size and builds a suffix array over the words of a shard: suffixes
sorted by their first words. Of the benchmark, every suffix (of an item's words) is looked up in every shard by binary
search; the range it finds holds all places where its first ten words occur. Suffixes that begin with a word pair no
benchmark text has can match none and are left out before the sort. From each place that is hit the longest verbatim match
is found in a suffix array of the benchmark's own words, by ranks of runs of 2 ** j words: no pair of places is ever listed.
The benchmark is handed out in blocks of bounded size, as arrays, one pass over the documents for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, lower_ascii, table, written

WINDOW = 10
#: Words of a shard, and bytes of benchmark text in a block.
SHARD_WORDS, BLOCK_BYTES = 1_000_000, 2 << 20
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(lower_ascii(text)) if text else []


class Suffixes:
    """The benchmark's side: ids of its words; by length, its windows with the items they belong to; and its own suffix array.

    All items stand in one array of ids with a nought behind each.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.items = window, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        each = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)), np.int64) for _, text in items]
        self.base = len(self.vocabulary) + 1
        self.words = np.concatenate([np.zeros(0, np.int64), *(x for ids in each for x in (ids, np.zeros(1, np.int64)))])
        size = np.array([len(ids) for ids in each], np.int64)
        #: Where items begin.
        self.begin = np.cumsum(size + 1) - size - 1
        pair = (self.words[:-1] > 0) & (self.words[1:] > 0)
        self.pairs = np.unique(self.words[:-1][pair] * self.base + self.words[1:][pair])
        self.singles = sorted({int(ids[0]) for ids in each if len(ids) == 1})
        #: By length: the windows, sorted, and for each where its items begin in the array of items, which ends the last.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(k, window) for k in size.tolist() if k}):
            own = np.flatnonzero(size == n if n < window else size >= window)
            count = size[own] - n + 1
            item = np.repeat(own, count)
            at = np.repeat(self.begin[own], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows = np.stack([self.words[at + k] for k in range(n)] + [item], 1)
            rows = np.unique(rows, axis=0)
            first = np.flatnonzero(np.append(True, (rows[1:, :n] != rows[:-1, :n]).any(1)))
            self.by_length[n] = rows[first, :n], np.append(first, len(rows)), rows[:, n].astype(np.int32)
        #: Ranks of runs of 2 ** j words, and the pairs of ranks of half as long runs that they stand for.
        self.ranks, self.halves = [self.words.astype(np.int32)], []
        reach = 1
        while reach < size.max(initial=0):
            r = self.ranks[-1].astype(np.int64)
            key = r * (len(r) + self.base) + np.append(r[reach:], np.zeros(min(reach, len(r)), np.int64))
            half, rank = np.unique(key, return_inverse=True)
            self.halves.append(half)
            self.ranks.append(rank.astype(np.int32))
            reach *= 2
        self.array = np.argsort(self.ranks[-1], kind="stable")

    def longest(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``words`` the length of its longest match in the benchmark, and where the benchmark has it."""
        same = [np.where(words > 0, words, -1)]
        for j, half in enumerate(self.halves):
            x = same[-1]
            y = np.append(x[1 << j :], np.full(min(1 << j, len(x)), -1))
            key = x * (len(self.words) + self.base) + y
            place = np.minimum(np.searchsorted(half, key), len(half) - 1)
            same.append(np.where((x >= 0) & (y >= 0) & (half[place] == key), place, -1))
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), len(self.words), np.int64), np.zeros(len(at), np.int64)

        def bound(rank, wanted, right):
            # the first place in [lo, hi) of the suffix array whose rank behind ``size`` words is not less (or is greater)
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                there = self.array[np.minimum(mid, len(self.array) - 1)] + size
                value = np.where(there < len(rank), rank[np.minimum(there, len(rank) - 1)], 0)
                less = (value <= wanted) if right else (value < wanted)
                a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
            return a

        for j in range(len(same) - 1, -1, -1):
            rank = self.ranks[j]
            ahead = at + size
            wanted = np.where(ahead < len(words), same[j][np.minimum(ahead, len(words) - 1)], -1)
            first = bound(rank, wanted, False)
            there = self.array[np.minimum(first, len(self.array) - 1)] + size
            found = (wanted >= 0) & (first < hi) & (there < len(rank)) & (rank[np.minimum(there, len(rank) - 1)] == wanted)
            if not found.any():
                continue
            last = bound(rank, wanted, True)
            lo, hi, size = np.where(found, first, lo), np.where(found, last, hi), np.where(found, size + (1 << j), size)
        return size, self.array[np.minimum(lo, max(len(self.array) - 1, 0))] if len(at) else lo

    def packed(self, ids: np.ndarray) -> np.ndarray:
        """Sort keys of rows of word ids: as many ids to a 64-bit column as fit."""
        each = max(1, int(62 // np.log2(self.base + 1)))
        cols = []
        for lo in range(0, ids.shape[1], each):
            key = np.zeros(len(ids), np.int64)
            for c in range(lo, min(lo + each, ids.shape[1])):
                key = key * self.base + ids[:, c]
            cols.append(key)
        return np.stack(cols, 1)

    def search(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(positions, windows, length) of all occurrences of windows in a shard. words: ids, 0 for words of no item."""
        if len(words) == 0:
            return []
        padded = np.concatenate([words, np.zeros(self.window, np.int64)])
        begins = np.zeros(len(words), bool)
        at = np.flatnonzero((words > 0) & (padded[1 : len(words) + 1] > 0))
        key = padded[at] * self.base + padded[at + 1]
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            begins[at[self.pairs[place] == key]] = True
        for one in self.singles:
            begins |= words == one
        start = np.flatnonzero(begins)
        suffix = np.stack([padded[start + k] for k in range(self.window)], 1) if len(start) else np.zeros((0, self.window), np.int64)
        keys = self.packed(suffix)
        order = np.lexsort(keys.T[::-1])
        array, keys, suffix = start[order], keys[order], suffix[order]
        out = []
        for n, (windows, _, _) in self.by_length.items():
            lo, hi = self.ranges(keys, windows) if n == self.window else self.ranges(self.packed(suffix[:, :n]), windows)
            if (size := hi - lo).any():
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append((array[np.repeat(lo, size) + within], np.repeat(np.arange(len(windows)), size), n))
        return out

    def ranges(self, keys: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search, the range of sorted ``keys`` that equals each window's."""
        wanted = self.packed(windows)
        lo, hi = np.searchsorted(keys[:, 0], wanted[:, 0], "left"), np.searchsorted(keys[:, 0], wanted[:, 0], "right")
        for c in range(1, keys.shape[1]):
            for k in np.flatnonzero(hi > lo):
                part = keys[lo[k] : hi[k], c]
                lo[k], hi[k] = lo[k] + np.searchsorted(part, wanted[k, c], "left"), lo[k] + np.searchsorted(part, wanted[k, c], "right")
        return lo, hi


def covered(positions: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, positions, 1)
    np.add.at(edge, positions + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _shards(texts: list, suffixes: Suffixes, shard_words: int) -> Iterator[tuple[np.ndarray, list]]:
    """For each text its words' ids and the hits (positions, windows, length) in it. Texts longer than a shard are searched in overlapping pieces."""
    get = suffixes.vocabulary.get
    every = [np.fromiter((get(w, 0) for w in tokens(text)), np.int64) for text in texts]
    hits: dict[int, list] = {}

    def flush(held):
        gap = np.zeros(1, np.int64)
        words = np.concatenate([x for h in held for x in (h[2], gap)])
        begin = np.cumsum([0] + [len(h[2]) + 1 for h in held])
        for at, window, n in suffixes.search(words):
            own = np.searchsorted(begin, at, "right") - 1
            order = np.argsort(own, kind="stable")
            own, at, window = own[order], at[order], window[order]
            cut = np.flatnonzero(np.diff(own)) + 1
            for o, a, w in zip(np.split(own, cut), np.split(at, cut), np.split(window, cut)):
                k, lo, _ = held[o[0]]
                hits.setdefault(k, []).append((a - begin[o[0]] + lo, w, n))

    held, words = [], 0
    for k, ids in enumerate(every):
        for lo in range(0, max(1, len(ids)), shard_words):
            held.append((k, lo, ids[lo : lo + shard_words + suffixes.window - 1]))
            words += len(held[-1][2])
            if words >= shard_words:
                flush(held)
                held, words = [], 0
    if held:
        flush(held)
    for k, ids in enumerate(every):
        yield ids, hits.get(k, [])


def _found(ids: np.ndarray, hits: list, suffixes: Suffixes) -> dict:
    """The struct that ``search`` gives for a text and a block."""
    out = {"n_words": len(ids), "spans": [], "items": [], "matches": []}
    if not hits:
        return out
    cover = np.zeros(len(ids), bool)
    begins = np.zeros(len(ids), bool)
    items = np.zeros(0, np.int32)
    for at, w, n in hits:
        cover |= covered(at, n, len(ids))
        begins[at] = True
        _, first, owner = suffixes.by_length[n]
        for k in np.unique(w).tolist():
            if not np.isin(own := owner[first[k] : first[k + 1]], items, assume_unique=True).all():
                items = np.union1d(items, own)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    out["spans"] = [{"at": int(a), "length": int(b - a)} for a, b in edge.reshape(-1, 2)]
    out["items"] = [suffixes.items[k] for k in items.tolist() if suffixes.items[k] is not None]
    # only the words that are hit, with a nought behind each span
    moved = np.cumsum(cover) + np.cumsum(np.diff(cover.astype(np.int8), prepend=0) == -1) - 1
    words = np.zeros(int(cover.sum()) + len(out["spans"]), np.int64)
    words[moved[cover]] = ids[cover]
    at = np.flatnonzero(begins)
    size, place = suffixes.longest(words, moved[at])
    reach = at + size
    new = np.append(True, reach[1:] > reach[:-1])
    item = np.searchsorted(suffixes.begin, place[new], "right") - 1
    out["matches"] = [{"item": suffixes.items[i], "at": a, "item_at": b, "words": n} for i, a, b, n in zip(item.tolist(), at[new].tolist(), (place[new] - suffixes.begin[item]).tolist(), size[new].tolist())]
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """Items in blocks of about ``block_bytes``, read one block at a time, and whether a block is the last."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        yield [(r.item_id, r.text) for r in numbered.filter(F.col("block") == b).orderBy("item_id", "text").select("item_id", "text").collect()], b == n - 1


FOUND = "n_words long, spans array<struct<at:long,length:long>>, items array<string>, matches array<struct<item:string,at:long,item_at:long,words:long>>"


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``_found``: an array with a struct for each block of the benchmark.

    A struct holds n_words, the merged spans of hit words, the items with occurring windows, and the longest matches: for
    each place at which a window begins the longest run of words that the block has too, unless the run from the place
    before reaches as far, with one place in the benchmark that has it. Null texts have no words; items with null ids are
    never named, but their windows count. An item has to fit in a block as a text has to fit in a task.
    """
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(FOUND).fields
    docs = docs.withColumn("_found", F.array().cast(T.ArrayType(T.StructType(fields))))

    def passed(docs, handed):
        def rows(texts):
            for ids, hits in _shards(texts, handed.value, shard_words):
                found = _found(ids, hits, handed.value)
                yield tuple(found[f.name] for f in fields)

        with_block = add_columns(docs, "text", [T.StructField(f"_{f.name}", f.dataType) for f in fields], rows)
        block = F.struct(*(F.col(f"_{f.name}").alias(f.name) for f in fields))
        return with_block.withColumn("_found", F.array_append("_found", block)).drop(*(f"_{f.name}" for f in fields))

    for block, last in _blocks(benchmark, block_bytes):
        handed = docs.sparkSession.sparkContext.broadcast(Suffixes(block, window))
        docs = passed(docs, handed)
        if not last:
            docs = written(docs, "searched")
            handed.unpersist()
    return docs


def hit_words() -> Column:
    """Words under the spans of any block."""
    spans = F.flatten(F.transform("_found", lambda f: f["spans"]))
    alone = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["length"])
    union = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))).cast("long")
    return F.when(F.size("_found") == 1, alone).otherwise(union)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and matches, a row for each row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows get equal results; with an empty benchmark nothing is
    hit. Other columns of ``docs`` are neither read nor returned.
    """
    found = search(docs.select("doc_id", "text"), benchmark, **how).drop("text")
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_found", lambda f: f["items"]))))
    n_hit = hit_words()
    return found.select("doc_id", F.col("_found")[0]["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.flatten(F.transform("_found", lambda f: f["matches"])).alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return search(packed, benchmark, **how).filter(hit_words() == 0).select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    places = F.transform(F.array_sort(F.transform("matches", lambda m: F.struct(m["at"].alias("at"), m["words"].alias("words")))), lambda m: F.concat_ws("+", m["at"].cast("string"), m["words"].cast("string")))
    return found.select(*found.columns[:-1], F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0).cast("long")).alias("longest_words"), F.array_join(places, ",").alias("places"))


#: The rows of op10_decontaminate in DuckDB's SQL: every window of a document against every window of the benchmark.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item, item_at, least(len(ws), 10) AS n, array_to_string(ws[item_at + 1 : item_at + least(len(ws), 10)], ' ') AS win FROM (SELECT item, ws, unnest(range(0, greatest(1, len(ws) - 9))) AS item_at FROM i WHERE len(ws) > 0)),
dw AS (SELECT rid, n, pos, array_to_string(ws[pos + 1 : pos + n], ' ') AS win FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS pos FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT rid, item, pos, item_at, n FROM dw JOIN iw USING (n, win)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid),
m AS (SELECT rid, min(pos) AS pos, max(pos) + n AS reach FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, item, pos - item_at, n ORDER BY pos) AS run FROM (SELECT DISTINCT * FROM h)) GROUP BY rid, item, pos - item_at, n, run),
b AS (SELECT rid, pos, max(reach) AS reach FROM m GROUP BY rid, pos),
o AS (SELECT rid, max(reach - pos) AS longest_words, string_agg(concat(pos, '+', reach - pos), ',' ORDER BY pos) AS places FROM (SELECT *, max(reach) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) WHERE before IS NULL OR reach > before GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest_words, 0) AS BIGINT) AS longest_words, coalesce(places, '') AS places
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid) LEFT JOIN o USING (rid)
"""
