"""The training-data operators against brute force, on a small fixture with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstone.llm import decontaminate, html, katz, lines, quality, sentencepieces, sharding, similar, simhash, suffixes, token_counts
from quillstone.llm.common import WORD, lower_ascii

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, shard int, gone int, row string"


@pytest.fixture(scope="module")
def docs(spark):
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    random.seed(3)
    words = "the a of and in word text data spark join".split()
    passage = " ".join(random.choice(words) + str(k) for k in range(60))
    extra = [
        (9001, None), (9002, ""), (None, "a b a b"), (9003, "the " * 60), (9004, "Über ÄB ẞ 梦 🙂 x\x00y"), (9005, "l1\nl2\nl3\nl4"), (9006, "l1\nl2\nl3\nz"),
        (9007, "s\ns\ns\ns\ns"), (9008, passage), (9009, "x y " + passage + " z"), (9009, "x y " + passage + " z"), (9010, "\n\n\n"), (9011, " \t "), (None, None),
        (9012, " ".join(w.upper() for w in passage.split())),
    ]
    rows = [*own, *((d, t, None, "s", None) for d, t in extra)]
    return spark.createDataFrame([(*r, "c", "k", 1, 2, "r") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_fingerprint(text):
    words = WORD.findall(lower_ascii(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, pairs):
    codes = [brute_fingerprint(t) for _, t in pairs]
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (d, _) in enumerate(pairs):
        least[find(k)] += [d] if d is not None else []
    want = sorted(((d, f"{c:016x}", min(least[find(k)], default=None)) for k, ((d, _), c) in enumerate(zip(pairs, codes))), key=str)
    assert rows_of(simhash.near_duplicates(docs)) == want


def brute_alike(pairs):
    """The doc_ids that stay, by comparing all pairs."""
    sets = []
    for _, t in pairs:
        w = WORD.findall(lower_ascii(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(pairs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k, (d, _) in enumerate(pairs):
        groups[find(k)].append(d)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def test_near_duplicate_stage(spark, docs, pairs):
    import corpus_pipeline

    random.seed(7)
    word = lambda: f"w{random.randrange(900)}"
    base = [word() for _ in range(100)]
    edited = []
    for k in range(40):
        # up to two words replaced: similarities of 0.81 and more to the base, less to each other; some chains of edits
        own = list(edited[-1][1].split() if k % 4 == 3 else base)
        for at in random.sample(range(100), 1 + k % 2):
            own[at] = word()
        edited.append((20000 - k, " ".join(own)))
    more = spark.createDataFrame([(d, t, None, None, None, "c", "k", 1, 2, "r") for d, t in edited], SCHEMA)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(more), SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == brute_alike(pairs + edited)


def test_minhashes_find_what_is_alike():
    rng = np.random.default_rng(3)
    minhashes, missed = similar.MinHashes(), 0
    for n in (4, 8, 40, 360, 9000):
        for _ in range(100):
            own = rng.integers(0, 2**64, n + n // 4, np.uint64, endpoint=False)
            missed += not (minhashes.keys(own) == minhashes.keys(own[:n])).any()
    assert missed == 0


def test_sets_alike():
    rng = np.random.default_rng(4)
    for _ in range(100):
        sets = [np.unique(rng.choice(14, rng.integers(1, 14), replace=False)).astype(np.uint64) for _ in range(12)]
        want = np.arange(12)
        for _ in range(12):
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                        want[i] = want[j] = min(want[i], want[j])
        assert (similar.alike(sets) == want).all()


def test_large_groups_are_dealt_again(spark):
    rng = np.random.default_rng(5)
    codes = np.unique(np.concatenate([rng.integers(0, 2**62, 300), (5 << 40) + rng.integers(0, 4000, 900)]))
    got = simhash.linked(spark.createDataFrame([(int(c),) for c in codes], "code long"), group=50)
    from quillstone.llm.components import components

    found = {r.node: r.component for r in components(got).collect()}
    label = {int(c): int(c) for c in codes}
    changed = True
    while changed:
        changed = False
        for i, c in enumerate(codes):
            near = codes[np.bitwise_count(codes ^ c) <= 3]
            m = min(label[int(x)] for x in near)
            for x in near:
                if label[int(x)] != m:
                    label[int(x)], changed = m, True
    assert {c: found.get(c, c) for c in label} == label


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(re.findall(r"[!-/:-@\[-`{-~]", text))


def brute_kept(rows):
    """Whether quality keeps each of ``rows`` (text, lang, source)."""
    groups, found = defaultdict(Counter), []

    def bucket(v):
        shift = max(0, len(bin(v)) - 2 - 6)
        return 32 * shift + (v >> shift)

    for t, lang, source in rows:
        n, chars, _, _, repeats, marks = brute_counts(t)
        values = {"word_length": 100 * chars // max(n, 1), "marks": 1000 * marks // max(chars, 1)}
        failed = n < 10 or 100 * repeats > 20 * n
        found.append((failed, values, (lang, source)))
        if not failed:
            for m, v in values.items():
                groups[lang, source, m][bucket(v)] += 1

    def merged(test):
        out = defaultdict(Counter)
        for (lang, source, m), c in groups.items():
            if test(lang, source):
                out[m] += c
        return out

    def blend(own, parent):
        total = sum(parent.values())
        return {b: quality.PARTS * own[b] + quality.PRIOR * quality.PARTS * n // total for b, n in parent.items()}

    def quartiles(sketch):
        total, upto, ends = sum(sketch.values()), 0, []
        for b in sorted(sketch):
            upto += sketch[b]
            s = max(b // 32 - 1, 0)
            ends.append((upto, (b - 32 * s) << s, ((b - 32 * s + 1) << s) - 1))
        return next(lo for u, lo, _ in ends if 4 * u >= total), next(hi for u, _, hi in ends if 4 * u >= 3 * total)

    every = merged(lambda *_: True)
    out = []
    for failed, values, (lang, source) in found:
        ok = not failed
        for m, v in values.items() if ok else ():
            by_lang = blend(merged(lambda a, _: a == lang)[m], every[m])  # noqa: B023
            (q1, q3), *others = (quartiles(x) for x in (blend(groups[lang, source, m], by_lang), by_lang, every[m]))
            reach = quality.FENCE * max(b - a + 1 for a, b in [(q1, q3), *others])
            ok &= v <= q3 + reach and (m not in quality.TWO_SIDED or v >= q1 - reach)
        out.append(ok)
    return out


def test_quality(docs, pairs):
    got = quality.quality(docs)
    want = sorted(((d, *(c := brute_counts(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t in pairs), key=str)
    assert rows_of(got.select("doc_id", *quality.COUNTS, "base_failed")) == want
    assert got.filter("base_failed AND kept").count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    full = docs.select("doc_id", "text", "lang", "source").collect()
    verdict = brute_kept([r[1:] for r in full])
    assert rows_of(got.select("doc_id", "kept")) == sorted(((r.doc_id, k) for r, k in zip(full, verdict)), key=str)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted((r.doc_id for r, k in zip(full, verdict) if k), key=str)


def test_long_texts_are_read_whole():
    text = " ".join(f"w{k * k % 7919}" for k in range(70_000)) + "\nend\nend"
    assert simhash.fingerprint(text) & 2**64 - 1 == brute_fingerprint(text)
    assert quality.text_counts(text) == brute_counts(text)


def test_quantile_buckets(spark):
    df = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b"))
    found = {r.id: r.b for r in df.collect()}
    assert all(found[k] == k for k in range(64)) and all(0 <= found[k + 1] - found[k] <= 1 for k in range(4999))


def brute_lines(pairs):
    """The texts that line dedup leaves, in the order of ``pairs``."""
    at = defaultdict(list)
    for d, t in sorted({p for p in pairs if p[1] is not None}, key=lambda p: (p[0] is None, p[0] or 0)):
        ls = t.split("\n")
        for k in range(len(ls) - 2):
            at[tuple(ls[k : k + 3])].append((d, t, k))
    gone, stay = defaultdict(set), defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for n, (d, t, k) in enumerate(places):
                (gone if n else stay)[d, t].update(range(k, k + 3))
    lost = {key: own - stay[key] for key, own in gone.items()}
    return [(d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost.get((d, t), ()))) for d, t in pairs]


def test_lines(docs, pairs):
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    assert rows_of(got.select("doc_id", "text")) == sorted(brute_lines(pairs), key=str)


def test_lines_of_a_long_text(spark):
    text = "\n".join(["a", "b", "c", "d"] * 20_000)
    left = lines.dedup_lines(spark.createDataFrame([(1, text), (2, "a\nb\nc")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in left} == dict(brute_lines([(1, text), (2, "a\nb\nc")]))


def brute_hits(pairs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each pair, in order."""
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    want = []
    for d, t in pairs:
        w, hit, found = tok(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return want


def test_decontamination(spark, docs, pairs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [("a1", "Data"), ("a2", None), ("a3", ""), ("b", "a, B a!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute_hits(pairs, items)
    want = sorted(want, key=str)
    for how in ({}, {"shard_words": 37}, {"block_bytes": 700}):
        assert rows_of(decontaminate.contamination(docs, bench, **how).drop("matches")) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted((r.doc_id for r in clean.select("doc_id").collect()), key=str) == sorted((w[0] for w in want if not w[-1]), key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def brute_repeats(pairs, across_only=False):
    """(doc_id, spans, gone) of documents with repeated windows of fifty words."""
    order = lambda p: (p[0] is None, p[0] or 0)
    places = defaultdict(list)
    for d, t in sorted({p for p in pairs if p[1] is not None}, key=order):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].append((d, t, k))
    out = []

    def runs(at):
        at, spans = sorted(at), []
        for k in at:
            if spans and k <= spans[-1][0] + spans[-1][1]:
                spans[-1][1] = k + 1 - spans[-1][0]
            else:
                spans.append([k, 1])
        return tuple(map(tuple, spans))

    cover, stay, late = defaultdict(set), defaultdict(set), defaultdict(set)
    for own in places.values():
        if len(own) > 1 and (not across_only or len({p[:2] for p in own}) > 1):
            for n, (d, t, k) in enumerate(own):
                cover[d, t].update(range(k, k + 50))
                (late if n else stay)[d, t].update(range(k, k + 50))
    for d, t in cover:
        out.append((d, runs(cover[d, t]), runs(late[d, t] - stay[d, t])))
    return sorted(out, key=str)


def test_suffixes(docs, pairs):
    got = suffixes.repeated_spans(docs).collect()
    assert sorted(((r.doc_id, tuple(map(tuple, r.spans)), tuple(map(tuple, r.gone))) for r in got), key=str) == brute_repeats(pairs, across_only=True)


def test_suffixes_within_documents(spark, docs, pairs, tmp_path):
    random.seed(9)
    word = lambda: f"v{random.randrange(10**6)}"
    a, b = ([word() for _ in range(n)] for n in (60, 49))
    own = [(9101, " ".join([*a, "x", *a])), (9102, " ".join([*b, "x", *b])), (9103, "y " * 51), (None, " ".join(["z", *a])), (9200, "q " * 40_000)]
    own += [(9104 + k, " ".join([*(c := [word() for _ in range(50 + k)]), *(word() for _ in range(30 * k)), *c])) for k in range(20)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = lambda spans: ",".join(f"{k}+{n}" for k, n in spans)
    repeats = brute_repeats([*pairs, *own])
    want = sorted(((d, len(s), sum(n for _, n in s), max(n for _, n in s), text(s), sum(n for _, n in g), text(g)) for d, s, g in repeats), key=str)
    assert {9003, 9101, 9103, *range(9104, 9124)} <= {w[0] for w in want} and 9102 not in {w[0] for w in want}
    assert rows_of(suffixes.op7_suffixes(spark, str(tmp_path))) == want
    kept = suffixes.dedup_suffixes(docs)
    assert kept.columns == docs.columns
    gone = {d: g for d, _, g in repeats}
    left = {r.doc_id: r.text for r in kept.filter("doc_id IS NOT NULL").collect()}
    for d, t in own:
        if d is not None:
            lost = {k for at, n in gone.get(d, ()) for k in range(at, at + n)}
            assert WORD.findall(left[d]) == [w for k, w in enumerate(WORD.findall(t)) if k not in lost]


def brute_shard(doc_id, weights, base, rack, region):
    """The shard of a doc_id by level-wise draws."""
    key = "null" if doc_id is None else str(doc_id)

    def draw(path, weight):
        h = xxh64_intdigest(key.encode(), xxh64_intdigest(path.encode(), 42))
        return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight

    paths = [(str(s // (rack * region)), str(s // rack % region)) if s < base else (f"+{s}", "0") for s in range(len(weights))]
    left = [s for s in range(len(weights)) if weights[s] > 0]
    for level in range(3):
        sums = defaultdict(float)
        name = lambda s: "/".join([*paths[s], str(s)][: level + 1])  # noqa: B023, E731
        for s in left:
            sums[name(s)] += weights[s]
        best = min(sums, key=lambda p: (draw(p, sums[p]), p)) if len(sums) > 1 else next(iter(sums))
        left = [s for s in left if name(s) == best]
    return left[0]


@pytest.mark.parametrize(("weights", "base", "rack", "region"), [([1.0] * 40, 40, 4, 3), ([1.0, 0.0, 3.5] * 5, 12, 2, 2), ([1.0] * 40, 40, 5, 8), ([2.0], 1, 4, 3)])
def test_sharding(docs, pairs, weights, base, rack, region):
    out = sharding.shard(docs, weights, base=base, rack=rack, region=region, rows_per_bucket=3).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), brute_shard(d, weights, base, rack, region), brute_shard(d, [*weights, 1.0], base, rack, region)) for d, t in pairs]
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in out), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, len(weights))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs.repartition(7, "text"), weights, base=base, rack=rack, region=region, rows_per_bucket=3)
    assert rows_of(again) == sorted(map(tuple, out), key=str)


def test_sharding_confines_movement(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = lambda w, **how: {r.doc_id: r.shard for r in sharding.shard(keys, w, None, **how).collect()}
    even, heavy = at([1.0] * 24), at([1.0] * 7 + [3.0] + [1.0] * 16)
    moved = [(even[k], heavy[k]) for k in even if even[k] != heavy[k]]
    assert moved and all(b // 12 == 0 for _, b in moved)  # into the region of shard 7
    assert all(b // 4 == 1 for a, b in moved if a // 12 == 0)  # within it into its rack
    assert all(b == 7 for a, b in moved if a // 4 == 1)
    counts = Counter(heavy.values())
    assert abs(counts[7] - 4000 * 3 / 26) < 120 and all(abs(counts[s] - 4000 / 26) < 70 for s in range(24) if s != 7)
    assert at([1.0] * 24, rack=2, region=3) != even  # the shape of the tree decides


def test_sharding_deals_out_rows_that_repeat(spark):
    rows = spark.range(50_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard(rows).agg(F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.countDistinct("shard")).first()
    assert tuple(out) == (50_000, 0, 49_999, 1)


def brute_katz(pairs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    texts = [(d, [*WORD.findall(lower_ascii(t or "")), "</s>"]) for d, t in pairs]
    c, c2, behind, after = Counter(), Counter(), Counter(), defaultdict(set)
    for d, t in texts:
        if not held(d):
            c.update(t)
            for h, w in zip(["<s>", *t], t):
                c2[h, w] += 1
                behind[h] += 1
                after[h].add(w)
    total, types = sum(c.values()), len(c)
    d1, d2 = (katz.discounts([sum(v == r for v in x.values()) for r in range(katz.CUT + 2)]) for x in (c, c2))
    less = lambda v, d: v * (d[v] if v <= katz.CUT else 1.0)
    unknown = 1 - sum(less(v, d1) for v in c.values()) / total
    share = lambda w: less(c[w], d1) / total if c[w] else unknown
    kept = {h: sum(less(c2[h, w], d2) for w in f) for h, f in after.items()}
    seen = {h: sum(share(w) for w in f) for h, f in after.items()}

    def p(w, h):
        if not behind[h]:
            return share(w)
        n = behind[h] + (kept[h] >= behind[h])
        return less(c2[h, w], d2) / n if c2[h, w] else (n - kept[h]) / n / (1 - seen[h]) * share(w)

    for h in sorted(after)[:20]:
        assert abs(sum(p(w, h) for w in c) + p("\0", h) - 1) < 1e-9
    return [(d, held(d), len(t), sum(c[w] > 0 for w in t), total, sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t), sum(math.log10(p(w, h)) for h, w in zip(["<s>", *t], t))) for d, t in texts]


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_katz(docs, pairs, block):
    want = sorted(brute_katz(pairs), key=str)
    got = rows_of(katz.scored(docs, block))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6)


def test_katz_scores_other_documents_from_its_tables(spark, docs, pairs):
    scores, tables = katz.modelled(docs, 5_000)
    assert tables.held.count() >= 3 * tables.parts and {r.kind for r in tables.held.select("kind").distinct().collect()} == {"word", "pair", "history"}
    again = rows_of(katz.score_with(tables, docs, 3_000))
    want = rows_of(scores)
    assert [g[:5] for g in again] == [w[:5] for w in want]
    for g, w in zip(again, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    other = spark.createDataFrame([(1, "qq1 qq2 qq3 qq4"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known) for r in katz.score_with(tables, other).collect()) == [(1, 5, 1), (2, 1, 1)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("katz_blocks")]


def test_katz_beats_its_base_on_held_out_texts(spark):
    out = katz.scored(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_sentencepieces():
    pieces = sentencepieces.load(sentencepieces.model_path())
    random.seed(2)

    def everything(text):
        word, out = sentencepieces.normalised(text), []

        def go(at, score, ids):
            if at == len(word):
                out.append((score, ids))
                return
            for end in range(at + 1, min(len(word), at + pieces.longest) + 1):
                s = pieces.score.get(word[at:end], pieces.unknown if end == at + 1 else None)
                if s is not None:
                    go(end, score + s, ids + pieces.edge(word[at:end]))

        go(0, 0.0, ())
        return sorted(out, key=lambda x: -x[0])

    for _ in range(150):
        text = "".join(random.choice(["a", "the", "in", " ", "é", "  ", "\n", "梦", "th", "🙂", ".", "\x00"]) for _ in range(random.randint(0, 7)))
        want, (ids, got) = everything(text), pieces.encode(text, 4)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:4]]
        score = dict(reversed(want) and [(i, s) for s, i in reversed(want)])
        assert abs(score[tuple(ids)] - want[0][0]) < 1e-6 and pieces.decode(ids) == text


def test_sentencepieces_of_a_long_word():
    pieces = sentencepieces.load(sentencepieces.model_path())
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.5 else rng.choice("etaoinshrdlu") for _ in range(300_000))
    began = time.process_time()
    ids, found = pieces.encode(text)
    assert time.process_time() - began < 60
    assert pieces.decode(ids) == text and len(found) == 4 and sorted(s for s, _ in found)[::-1] == [s for s, _ in found]


def test_encoding_round_trip(docs, pairs):
    got = sentencepieces.encoded(docs)
    assert got.count() == len(pairs) and got.filter("NOT round_trip").count() == 0
    assert got.filter("doc_id = 9001").first().ids == []


def test_token_counts(docs, pairs):
    t = token_counts.load(token_counts.tokenizer_path())
    want = sorted(((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False)), n > 1024) for d, x in pairs), key=str)
    assert rows_of(token_counts.token_counts(docs).drop("n_chunks")) == want
    small = token_counts.token_counts(docs, huge=100, chunk=120, overlap=10)
    assert rows_of(small.drop("n_chunks")) == want and small.filter("n_chunks > 1").count() > 100


def test_token_counts_resynchronise():
    t = token_counts.load(token_counts.tokenizer_path())
    encode = lambda x: t.encode(x, add_special_tokens=False)
    random.seed(1)
    parts = ["a", "b ", "\n", "  ", "é", "世界", "<|endoftext|>", "<|endo", "1", "'s", "!?", " word", "🙂", "\t", "   x"]
    for _ in range(300):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 400)))
        assert token_counts.count_chunked(encode, text, random.randint(80, 150), random.randint(1, 40))[0] == len(encode(text))
    for text in ("a" * 5000, "é" * 3000, " " * 4000, "ab" * 2000 + " " + "c" * 3000, "<|endoftext|>" * 300):
        assert token_counts.count_chunked(encode, text, 200, 20)[0] == len(encode(text))


def test_token_counts_splice_the_long_documents_of_the_table(spark):
    out = token_counts.op6_token_counts(spark, SF).agg(F.sum((F.col("n_chunks") > 1).cast("int")), F.max("n_chunks")).first()
    assert out[0] >= 1 and out[1] >= 2


def test_html():
    v = html.visible_text
    assert v(None) == v("") == v("<div><!-- x --></div>") == v("<p hidden>x</p><script>a</script>") == ""
    assert v("<p>one <b>two</b>\n three<p>four<br>five") == "one two three\n\nfour\nfive"
    assert v("<ul><li>a<li>b<ol start=3><li>c</ol><li>d</ul>") == "- a\n- b\n  3. c\n- d"
    assert v("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "a\n  b\nc\n  d"
    assert v('a<span style="visibility: hidden">b</span>c<!--d') == "ac"
    assert v("<pre>  a\n   b</pre>") == "  a\n   b"
    assert v("a < b &amp; c <3 <p title='x > y'>d</p") == "a < b & c <3\n\nd"


def test_html_tables():
    v = html.visible_text
    assert v("<table><tr><th>Name<th>Qty<tr><td>Apples<td>5</table>") == "Name    Qty\nApples  5"
    assert v("<table>x<tr><td>y</table>") == "x\ny"
    assert v("<table><tr><td colspan=2>Head<td>X<tr><td>a<td>b<td>c</table>") == "Head  X\na  b  c"
    assert v("<table><tr><td rowspan=2>A<td>1<tr><td>2<tr><td>B<td>3</table>") == "A  1\n   2\nB  3"
    assert v("<table><tr><td>梦<td>1<tr><td>ab<td>2</table>") == "梦  1\nab  2"
    assert v("<table><tr><td>x<table><tr><td>1<td>2</table><td>y</table>") == "x\n\n1  2\n\ny"


def test_html_visibility():
    v = html.visible_text
    assert v('a<div style="visibility:hidden">b<i style="visibility:visible">c</i>d</div>e') == "a\nc\ne"
    assert v("<details><summary>s</summary>body</details><details open><summary>t</summary>shown</details>") == "s\n\nt\nshown"
    assert v("<math><mi>x</mi><annotation>tex</annotation></math><svg><title>no</title><path/><text>yes</text></svg>") == "xyes"
    rules = "<style>.x{display:none} p#y{visibility:hidden}@media print{b{display:none}}@media screen{u{display:none}}</style>"
    assert v(rules + "<p class='a x'>1</p><p id=y>2</p><b>3</b><u>4</u><p class=x style='display:block'>5") == "3\n\n5"


def test_html_shows_the_visible_words_in_order():
    """Random pages whose visible words are known from the way they are made."""
    rng = random.Random(11)
    count = 0

    def made(depth, visible):
        nonlocal count
        out, words = [], []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["word", "word", "block", "hidden", "again", "list", "table", "script", "inline"]) if depth < 5 else "word"
            inner = lambda see: made(depth + 1, see)
            if kind == "word":
                count += 1
                out.append(f" w{count} ")
                words += [f"w{count}"] * visible
            elif kind == "script":
                out.append("<script>no('<p>no')</script><!-- <p>no -->")
            elif kind in ("block", "inline"):
                tag = rng.choice(["div", "section", "blockquote", "h2"] if kind == "block" else ["b", "i", "span"])
                text, own = inner(visible)
                out.append(f"<{tag}>{text}</{tag}>")
                words += own
            elif kind == "hidden":
                text, _ = inner(False)
                out.append(f"<div {rng.choice(['hidden', 'style=display:none', 'class=gone'])}>{text}</div>")
            elif kind == "again" and visible:
                text, own = inner(True)
                out.append(f"<div style='visibility:hidden'>no<div style='visibility:visible'>{text}</div>no</div>")
                words += own
            elif kind == "list":
                items = [inner(visible) for _ in range(rng.randint(1, 3))]
                out.append("<ul>" + "".join(f"<li>{t}" for t, _ in items) + "</ul>")
                words += [w for _, own in items for w in own]
            elif kind == "table":
                count += 4
                out.append(f"<table><tr><td>w{count - 3}<td>w{count - 2}<tr><td>w{count - 1}<td>w{count}</table>")
                words += [f"w{count - k}" for k in (3, 2, 1, 0)] * visible
        return "".join(out), words

    for _ in range(300):
        page, words = made(0, True)
        assert [w for w in html.visible_text("<style>.gone{display:none}</style>" + page).split() if w != "-"] == words


HOSTILE = {
    "open blocks": "<div>" * 16_000 + "<p>x" * 16_000, "open tags": "<b>" * 300_000, "nested tables": "<table><tr><td>x<td>" * 50_000, "nested lists": "<ul><li>x" * 100_000, "ends": "<table><tr><td>" + "<i>" * 16_000 + "</b>" * 64_000,
    "signs": "<" * 1_000_000, "attributes": "<a " + "a=b " * 250_000, "quotes": "<a href='" * 100_000, "comments": "<!--" * 250_000, "spans": "<table>" + "".join(f"<tr><td colspan={k % 1000}>x" for k in range(50_000)), "rules": "<style>" + ".a{display:none}" * 60_000 + "</style><p class=a>x",
    "elements of one rule": "<style>" + ".a{visibility:visible}" * 16_000 + "</style>" + "<p class=a>x" * 40_000, "elements of many rules": "<style>" + "".join(f".a.b{k}{{display:none}}" for k in range(16_000)) + "</style>" + "<p class='a c'>x" * 30_000,
    "wide cell": "<table><tr><td>" + "x" * 400_000 + "<td>y" + "<tr><td>a<td>b" * 40_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_takes_linear_time(name):
    began = time.process_time()
    text = html.visible_text(HOSTILE[name])
    assert time.process_time() - began < 20
    assert len(text) < 60 * len(HOSTILE[name])


def test_html_rules_of_equal_selectors():
    shown = lambda sheet, body: html.visible_text(f"<style>{sheet}</style>{body}")
    assert shown(".a{display:none} .a{visibility:hidden} .a{display:block}", "<p class=a>x<b style='visibility:visible'>y</b>") == "y"
    assert shown(".a.b{display:none} .a{display:block}", "<p class='b a'>x<p class=a>y") == "y"
    assert shown("#i{display:block} .a.b{display:none}", "<p id=i class='a b'>x") == "x"
    assert shown(".a{display:none} p{display:block}", "<p class=a>x<p>y") == "y"


def test_html_wide_cells():
    page = "<table><tr><td>" + "w" * 300 + "<td>z<tr><td>a<td>b</table>"
    assert html.visible_text(page) == "w" * 300 + "  z\na" + " " * 81 + "b"


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "t"), (1, "<p>a</p>", "t"), (None, None, None)], "page_id long, html string, text string")
    assert rows_of(html.extracted(pages)) == sorted([(1, "a"), (1, "a"), (None, "")], key=str)


def test_decontamination_of_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "a " * 20_000), (2, "b c " * 5_000 + "d"), (3, "x")], "doc_id long, text string")
    items = [("i", "a " * 2_000), ("j", "b c " * 10), ("k", "c d")]
    began = time.process_time()
    out = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert time.process_time() - began < 30
    assert (out[1].n_hit, out[1].n_items, max(m.words for m in out[1].matches)) == (20_000, 1, 2_000)
    assert (out[2].n_hit, out[2].n_items, max(m.words for m in out[2].matches)) == (10_001, 2, 20)
    assert not out[3].contaminated and out[3].matches == []


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for f in (simhash.near_duplicates, simhash.keep_one, quality.quality, quality.keep_good, lines.dedup_lines, sharding.shard, katz.scored, sentencepieces.encoded, token_counts.token_counts, suffixes.repeated_spans, suffixes.dedup_suffixes):
        assert f(none).count() == 0
    assert html.extracted(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert decontaminate.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_pipeline_keeps_the_rows_of_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    base = [f"w{rng.randrange(500)}," for _ in range(60)]
    near = [(9300 + k, " ".join([*base[:k], "x", *base[k + 1 :]])) for k in range(1, 4)]
    tied = [(9400, "\n".join(f"line {k} of some text, that is told." for k in range(4)))] * 2
    more = spark.createDataFrame([(d, t, "en", "s", None, "c", "k", 1, 2, "r") for d, t in [*near, *tied, (None, near[0][1])]], SCHEMA)
    every = docs.unionByName(more)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [("n", None)]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in every.select("doc_id", "text", "lang", "source").collect()]
    left = [r[:2] for r, k in zip(rows, brute_kept([r[1:] for r in rows])) if k]
    left = brute_lines(left)
    best: dict = {}
    for d, t in sorted(set(left), key=lambda p: (p[0] is None, p[0] or 0)):
        best.setdefault(d, []).append(t)
    kept = brute_alike(left)
    assert len(kept) < len(left) and all(len(best[d]) == 1 for d in kept)
    left = [(d, best[d][0]) for d in kept]
    left = [p for p, hit in zip(left, brute_hits(left, bench)) if not hit[-1]]
    pieces = sentencepieces.load(sentencepieces.model_path())
    want = sorted(((d, tuple(pieces.encode(t or "")[0])) for d, t in left), key=str)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.filter("NOT round_trip").count() == 0
    assert sorted(((r.doc_id, tuple(r.ids)) for r in out.select("doc_id", "ids").collect()), key=str) == want


def test_pipeline_of_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("how", [{"group": 2}, {"compared": 200}, {"compared": 200, "group": 2}])
def test_near_duplicates_in_parts(spark, how):
    """Groups that are too large for a task are dealt out, and nothing is lost."""
    rng = random.Random(17)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(3)]
    own = []
    for k in range(90):
        words = list(base[k % 3])
        for at in rng.sample(range(60), k % 4):
            words[at] = f"e{rng.randrange(50)}"
        own.append((k, " ".join(words)))
    got = simhash.keep_one(spark.createDataFrame(own, "doc_id long, text string"), **how)
    assert sorted((r.doc_id for r in got.collect()), key=str) == brute_alike(own)
