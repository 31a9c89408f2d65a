"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints that differ in at most k bits agree on at least one of k + 1 bands of bits, so bands route them to groups.
Within a group, fingerprints are sorted by Gray rank and an index of nodes is built over them: a node keeps the bits that
all below it share (its mask and pattern). The search for links descends pairs of nodes; the bits at which both nodes'
patterns are fixed and differ accumulate on the way down, and a pair of groups is pruned once they exceed k. Where the
bits that are not shared number at most k, the two groups are linked as a whole. A group too large for a task is dealt
out again by bands of its remaining bits, which loses no link.

``keep_one`` follows another rule, that of near duplicates by word shingles: a Jaccard similarity of 0.8 or more. Sets that
similar differ in some ten bits of their fingerprints (four standard deviations: WIDE bits), too many for bands of bits to
route by. There minhash bands route the fingerprints to groups, the same index prunes each group at WIDE bits, and the sets
of what it leaves linked are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, add_columns, lower_ascii, table, written
from .components import components
from .similar import LEAST, MinHashes, alike, set_code, shingle_set
from .similar import SHINGLE as WORDS
from .suffixes import Hashes

SHINGLE, BITS, SEED = 3, 64, 42
DIFFERENCES = 3
#: Fingerprints of a group beyond which it is dealt out again, and of a batch of groups that is indexed at once.
GROUP, BATCH = 20_000, 50_000
FAN = 8
BLOCK = 1 << 16
#: Differing bits of fingerprints up to which sets of shingles are compared, and shingles that a task compares with as many others.
WIDE, COMPARED = 24, 1_000_000
#: Words whose hashes a worker remembers, which bounds its memory.
REMEMBERED = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as a signed integer."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = map(" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([" ".join(words)])
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, BLOCK):
        ones += ones_of(np.fromiter((xxh64_intdigest(s, SEED) for s in islice(joined, BLOCK)), np.uint64, min(BLOCK, n - lo)))
    return majority(ones, n)


def ones_of(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles' hashes, as a signed integer; nought for none."""
    return majority(sum((ones_of(shingles[lo : lo + BLOCK]) for lo in range(0, len(shingles), BLOCK)), np.zeros(BITS, np.int64)), len(shingles))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order: the inverse of r ^ (r >> 1)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Index:
    """A hierarchical index over fingerprints sorted by group and Gray rank."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, fan: int = FAN):
        self.fan, self.codes = fan, codes
        #: For each level: bits that all codes below have, bits that any has, first and last group.
        self.levels = [(codes, codes, groups, groups)]
        while len(self.levels[-1][0]) > 1:
            a, o, g, h = self.levels[-1]
            at = np.arange(0, len(a), fan)
            self.levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at), np.minimum.reduceat(g, at), np.maximum.reduceat(h, at)))

    def expand(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, in order, of pairs of nodes of ``level``."""
        k = np.arange(self.fan)
        x = (i[:, None, None] * self.fan + k[None, :, None]).repeat(self.fan, 2).ravel()
        y = (j[:, None, None] * self.fan + k[None, None, :]).repeat(self.fan, 1).ravel()
        n = len(self.levels[level - 1][0])
        keep = (x <= y) & (y < n) & (x < n)
        return x[keep], y[keep]


def root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of x[k] and y[k] for all k; roots are the least members. parent stays flat."""
    while len(x):
        a, b = parent[x], parent[y]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        keep = lo != hi
        if not keep.any():
            return
        x, y, lo, hi = x[keep], y[keep], lo[keep], hi[keep]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def links(codes: np.ndarray, groups: np.ndarray, differences: int = DIFFERENCES, chunk: int = 1 << 18) -> np.ndarray:
    """For each code the least position that links reach within its group. Codes are sorted by (group, Gray rank)."""
    n = len(codes)
    parent = np.arange(n)
    if n < 2:
        return parent
    index = Index(codes, groups)
    top = len(index.levels) - 1
    zero = np.zeros(1, np.int64)
    todo = [(top, zero, zero)]
    while todo:
        level, i, j = todo.pop()
        if len(i) > chunk:
            todo += [(level, i[chunk:], j[chunk:]), (level, i[:chunk], j[:chunk])]
            continue
        a, o, first, last = index.levels[level]
        near = (first[j] <= last[i]) & (first[i] <= last[j])
        i, j = i[near], j[near]
        apart = np.bitwise_count((a[i] & ~o[j]) | (a[j] & ~o[i]))
        near = apart <= differences
        i, j = i[near], j[near]
        if level == 0:
            pair = i < j
            unite(parent, i[pair], j[pair])
            continue
        # whole groups: one group of codes, and no two codes below can differ in more bits
        spread = np.bitwise_count((o[i] | o[j]) & ~(a[i] & a[j]))
        whole = (spread <= differences) & (first[i] == last[j]) & (first[j] == last[i])
        width = index.fan**level
        lo, hi = np.minimum((i + 1) * width, n) - 1, np.minimum((j + 1) * width, n)
        if whole.any():
            for x, y, up, end in zip(i[whole] * width, j[whole] * width, lo[whole], hi[whole]):
                members = np.concatenate([np.arange(x, up + 1), np.arange(y, end)])
                unite(parent, np.full(len(members), x), members)
            i, j, lo, hi = i[~whole], j[~whole], lo[~whole], hi[~whole]
        if len(i):
            # pairs of nodes whose codes are all in one set already have nothing to add
            change = np.concatenate([[0], np.cumsum(parent[1:] != parent[:-1])])
            one = (change[lo] == change[i * width]) & (change[hi - 1] == change[j * width]) & (parent[lo] == parent[hi - 1])
            i, j = i[~one], j[~one]
            x, y = index.expand(level, i, j)
            todo.append((level - 1, x, y))
    return root(parent, parent)


def bands(remaining: list[int], differences: int) -> list[list[int]]:
    """The bits of ``remaining`` in differences + 1 bands."""
    n = differences + 1
    return [b for k in range(n) if (b := remaining[k * len(remaining) // n : (k + 1) * len(remaining) // n])]


def routed(rows: DataFrame, differences: int) -> DataFrame:
    """Each (code, mask, free) once for each band of the bits ``free``; ``mask`` then holds the band too, and ``key`` the code's bits under it."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            code, mask, free = (np.asarray(c).view(np.uint64) for c in b.columns)
            for m, f in np.unique(np.stack([mask, free]), axis=1).T.tolist():
                own = code[(mask == np.uint64(m)) & (free == np.uint64(f))]
                for band in bands([k for k in range(BITS) if (f >> k) & 1], differences):
                    more = np.full(len(own), m | sum(1 << k for k in band), np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (own, more, own & more)], names=["code", "mask", "key"])

    return rows.select("code", "mask", "free").mapInArrow(run, "code long, mask long, key long")


def linked(codes: DataFrame, differences: int = DIFFERENCES, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints, enough to connect all that links of at most ``differences`` bits connect.

    codes: distinct fingerprints (code: long). A group of more than ``group`` (at least 2 to the power of differences + 1)
    is dealt out again by bands of the bits in which its members differ at all, so that every band parts it.
    """
    rows = codes.select("code", F.lit(0).cast("long").alias("mask"), F.lit(-1).cast("long").alias("free"))
    edges = None
    while True:
        rows = written(routed(rows, differences), "routed")
        sized = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.expr("bit_or(code) & ~bit_and(code)").alias("free"))
        large = written(sized.filter(F.col("n") > group).select("mask", "key", "free"), "large")
        hot = bool(large.take(1))
        fit = rows.join(large, ["mask", "key"], "left_anti") if hot else rows
        found = _indexed(fit, differences)
        edges = found if edges is None else edges.unionByName(found)
        if not hot:
            return edges
        rows = rows.join(large, ["mask", "key"]).select("code", "mask", "free")


def _indexed(rows: DataFrame, differences: int, batch: int = BATCH) -> DataFrame:
    """The edges (a, b) within groups (mask, key) of codes: groups come together by a shuffle and are indexed some at a time.

    A column ``node`` names what a code stands for, and edges are between nodes; without it, nodes are codes.
    """
    import pyarrow as pa

    def run(batches):
        held: list = []
        size = 0

        def flush(mask, key, code, node):
            new = np.ones(len(code), bool)
            new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
            number = np.cumsum(new)
            count = np.bincount(number)
            keep = count[number] > 1
            code, node, number = code[keep].view(np.uint64), node[keep], number[keep]
            order = np.lexsort((gray_rank(code), number))
            code, node, number = code[order], node[order], number[order]
            to = links(code, number, differences)
            at = np.flatnonzero(node != node[to])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[to[at]])], names=["a", "b"])

        for b in batches:
            held.append([np.asarray(b.column(k)) for k in range(4)])
            size += b.num_rows
            if size >= batch:
                whole = [np.concatenate(c) for c in zip(*held)]
                mask, key = whole[:2]
                cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
                if len(cut):
                    k = cut[-1] + 1
                    yield from flush(*(c[:k] for c in whole))
                    held, size = [[c[k:] for c in whole]], len(key) - k
        if held:
            yield from flush(*(np.concatenate(c) for c in zip(*held)))

    node = F.col("node") if "node" in rows.columns else F.col("code")
    return rows.select("mask", "key", "code", node.alias("node")).repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a column ``_code``: the fingerprint of the whole text."""
    return add_columns(docs, "text", [T.StructField("_code", T.LongType())], lambda texts: ((fingerprint(t, shingle),) for t in texts))


def classes(coded: DataFrame, differences: int = DIFFERENCES) -> DataFrame:
    """(code, component_id, label): for each distinct code of ``coded`` (doc_id, code) the least doc_id that links reach, and the least code."""
    nodes = written(coded.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    found = components(linked(nodes.select("code"), differences))
    named = written(nodes.join(found, nodes["code"] == found["node"], "left").select("code", "first", F.coalesce("component", "code").alias("label")), "named")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(least, "label").select("code", "component_id", "label")


def near_duplicates(docs: DataFrame, differences: int = DIFFERENCES, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, a row for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint nought and are linked like any other. Equal rows are in one component; a
    component whose doc_ids are all null has a null id. Other columns of ``docs`` are neither read nor returned.
    """
    coded = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", F.col("_code").alias("code")), "coded")
    found = written(classes(coded, differences), "classes")
    return coded.join(found, "code").select("doc_id", hexed(F.col("code")).alias("fingerprint"), "component_id")


def hexed(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, hash, code, size, fingerprint, keys): the hash of the text, and of its set of shingles a hash, the size, the SimHash and the bands' keys."""
    fields = [T.StructField("code", T.LongType()), T.StructField("size", T.LongType()), T.StructField("fingerprint", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    minhashes, word_hashes = MinHashes(), Hashes(REMEMBERED)

    def rows(texts: list) -> Iterator[tuple]:
        for text in texts:
            s = shingle_set(text, word_hashes, shingle)
            yield set_code(s), len(s), set_fingerprint(s), minhashes.keys(s).tolist() if len(s) else []

    return add_columns(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), "text", fields, rows).drop("text")


def _candidates(nodes: DataFrame, group: int, wide: int = WIDE) -> DataFrame:
    """(node, component) for the sets that others may be similar to. nodes: code, fingerprint, keys.

    Groups of a band that hold more than ``group`` sets (close copies, in the main) aren't indexed in a task: all their
    members go to one component, so that nothing is lost.
    """
    banded = written(nodes.select("code", "fingerprint", F.explode("keys").alias("key")), "banded")
    sized = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("code").alias("least")).filter("n > 1")
    shared = written(banded.join(sized, "key"), "shared")
    found = _indexed(shared.filter(F.col("n") <= group).select(F.lit(0).cast("long").alias("mask"), "key", F.col("fingerprint").alias("code"), F.col("code").alias("node")), wide)
    return components(found.unionByName(shared.filter(F.col("n") > group).select(F.col("code").alias("a"), F.col("least").alias("b"))))


def _compared(rows: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """(code, label): edges that connect similar sets. rows: the group (candidate, i, j), code, label and part of a text; a group is one task's at a time."""
    import pyarrow as pa

    def run(batches):
        word_hashes, group, held = Hashes(REMEMBERED), None, {}

        def flush():
            codes = np.array(sorted(held), np.int64)
            label, part = (np.array([held[c][k] for c in codes.tolist()]) for k in (1, 2))
            to = alike([held[c][0] for c in codes.tolist()], least, label, part if group[1] != group[2] else None)
            at = np.flatnonzero(codes[to] != codes)
            return pa.RecordBatch.from_arrays([pa.array(codes[at]), pa.array(codes[to[at]])], names=["code", "label"])

        for b in batches:
            for c, i, j, code, label, part, text in zip(*(b.column(k).to_pylist() for k in range(6)), b.column(6)):
                if (c, i, j) != group:
                    if held:
                        yield flush()
                    group, held = (c, i, j), {}
                if code not in held:
                    held[code] = shingle_set(text.as_py(), word_hashes, shingle), label, part
        if held:
            yield flush()

    key = ["candidate", "i", "j"]
    return rows.select(*key, "code", "label", "part", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "code long, label long")


def similar_sets(texts: DataFrame, shingle: int = WORDS, least: tuple[int, int] = LEAST, compared: int = COMPARED) -> DataFrame:
    """(code, label): for sets that are linked to others, the least code of their component. texts: candidate, code, size, text.

    Groups of candidates of up to ``compared`` shingles are compared in one task. Larger ones are dealt into parts of that
    size by a hash: first each part is compared in itself, then the parts with each other, where sets that are in one
    component already are passed over; groups that the first pass has made one component are left out of the second.
    """
    total = texts.groupBy("candidate").agg(F.ceil(F.sum("size") / compared).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("code", F.lit(1)), F.col("parts")).cast("int")
    dealt = written(texts.select("candidate", "code", "text").join(total, "candidate").withColumn("part", part), "dealt")
    first = dealt.select("candidate", F.col("part").alias("i"), F.col("part").alias("j"), "code", F.col("code").alias("label"), "part", "text")
    edges = written(_compared(first, shingle, least), "compared")
    split = dealt.filter("parts > 1")
    if split.take(1):
        found = components(edges.select(F.col("code").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("code"), F.col("component").alias("label"))
        known = split.select("candidate", "code", "parts", "part").join(found, "code", "left").withColumn("label", F.coalesce("label", "code"))
        open_ = written(known.groupBy("candidate").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("candidate"), "open")
        rest = split.select("candidate", "code", "text").join(known.join(open_, "candidate", "left_semi").hint("merge"), ["candidate", "code"])
        pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
        second = _compared(pairs.select("candidate", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "code", "label", "part", "text"), shingle, least)
        edges = edges.unionByName(written(second, "compared"))
    return components(edges.select(F.col("code").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("code"), F.col("component").alias("label"))


def keep_one(docs: DataFrame, shingle: int = WORDS, least: tuple[int, int] = LEAST, group: int = GROUP, compared: int = COMPARED) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each component of similar texts, that of its least doc_id, with all columns, whatever their names.

    Texts are linked if the Jaccard similarity of their sets of shingles (runs of words, A-Z in lower case) is ``least``
    or more; texts without a word, nulls among them, are all alike. Of rows that share that doc_id and its text one stays;
    null doc_ids come last. An empty table stays empty.
    """
    coded = written(_sets(docs, shingle), "coded")
    order = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "hash")
    nodes = written(coded.groupBy("code").agg(F.min(order).alias("best"), *(F.first(c).alias(c) for c in ("size", "fingerprint", "keys"))), "nodes")
    candidates = _candidates(nodes.select("code", "fingerprint", "keys"), group)
    chosen = written(candidates.join(nodes.select(F.col("code").alias("node"), "size", "best"), "node").select(F.col("component").alias("candidate"), F.col("node").alias("code"), "size", "best.doc_id", "best.hash"), "candidates")
    texts = keyed(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")).join(keyed(chosen).hint("merge"), KEYS)
    labels = similar_sets(texts.select("candidate", "code", "size", "text"), shingle, least, compared)
    named = nodes.select("code", "best").join(labels, "code", "left")
    kept = written(named.groupBy(F.coalesce("label", "code").alias("label")).agg(F.min("best").alias("best")).select("best.doc_id", "best.hash"), "kept")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    return keyed(packed).join(keyed(kept).hint("merge"), KEYS, "left_semi").dropDuplicates(KEYS).select("row.*")


#: doc_id as two columns that are never null, with the hash of the text: plain keys, so that one shuffle serves a join and what follows.
KEYS = ["hash", "id", "none"]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.isnull("doc_id")}).drop("doc_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
