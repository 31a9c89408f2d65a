"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillstone.llm import spelling

SF = "/root/testdata/sf0.001"


def documents():
    random.seed(5)
    base = ["".join(random.choice("abc") for _ in range(random.randint(6, 8))) for _ in range(60)] + ["größeren", "ßßßßßß×÷", "a" * 40, "aaaaaab", "aaaaaa", "aaaaaaa", "z" * 3000]
    texts = []
    for k in range(120):
        picked = [random.choice(base) for _ in range(80)]
        for i in range(0, 80, 9):
            w = list(picked[i])
            at, how = random.choice([0, 3, len(w) - 1]), random.randrange(3)
            w[at : at + (how < 2)] = {0: "", 1: "c", 2: "d"}[how]
            picked[i] = "".join(w)
        texts.append((k, " ".join(w.upper() if random.random() < 0.1 else w for w in picked) + ", ÄÖÜäöü über_über 12ab34"))
    return [*texts, texts[0], texts[0], (None, texts[1][1]), (500, None), (501, ""), (502, "Common1common commons"), (None, None)]


def brute_words(docs):
    out = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(docs):
    n = brute_words(docs)
    near = defaultdict(list)
    listed = sorted(n)
    by_size = defaultdict(list)
    for w in listed:
        by_size[len(w)].append(w)
    for a in listed:
        for b in by_size[len(a)] + by_size[len(a) + 1]:
            if (len(b) > len(a) or a < b) and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in listed:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in listed}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("frequent, seldom, size", [(spelling.FREQUENT, spelling.SELDOM, spelling.LIST), (50, 1, 3), (1000, 0, 10**6), (5, 10**9, 0)])
def test_spelling(spark, frequent, seldom, size):
    docs = documents()
    df = spark.createDataFrame([(*r, "w", "f", 1) for r in docs], "doc_id long, text string, word string, form string, n long")
    want = brute(docs)
    assert sum(v[3] for v in want.values()) > 50 and any(v[0] for v in want.values())
    assert rows_of(spelling.spelling_variants(df, frequent=frequent, seldom=seldom, list_size=size)) == want


def test_spelling_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(spelling.op12_spelling(spark, SF)) == brute(docs)


def test_bounds_leave_a_gram():
    """Grams that an edit leaves are shared: as many as the bound says, at the same place from the start or the end."""
    random.seed(1)
    word = lambda n: "".join(random.choice("ab") for _ in range(n))
    frequent = {g: random.randint(1, 9) for q in (2, 3, 4) for g in {word(q) for _ in range(6)}} | {spelling.OPENS + "a": 5}
    for _ in range(3000):
        a = word(random.randint(6, 12))
        at = random.randrange(len(a) + 1)
        b = random.choice([a[:at] + random.choice("abc") + a[at:], a[:at] + "c" + a[at + 1 :], a[:at] + a[at + 1 :] if at < len(a) else a[:-1]])
        signed = [f"{spelling.OPENS}{w}{spelling.CLOSES}" for w in (a, b)]
        grams = [spelling.decomposed(w, frequent) for w in signed]
        places = [{k for s, e in g for k in ((s, w[s:e]), (s - len(w), w[s:e]))} for g, w in zip(grams, signed)]
        kept = sum((s, signed[0][s:e]) in places[1] or (s - len(signed[0]), signed[0][s:e]) in places[1] for s, e in grams[0])
        bound = len(grams[0]) - spelling.affected(grams[0], len(signed[0]))
        assert bound >= 1 and kept >= bound
        assert a == b or min(len(a), len(b)) < 6 or set(spelling.keys(a, frequent)) & set(spelling.keys(b, frequent))


def test_hub_of_many_variants(spark):
    """A word with a thousand words one edit away, and lists that are all crowded."""
    hub = "international"
    letters = [chr(c) for c in range(0xDF, 0x100)] + list("abcdefghijklmnopqrstuvwxyz")
    variants = {hub[:i] + c + hub[i + 1 :] for i in range(len(hub)) for c in letters} | {hub[:i] + c + hub[i:] for i in range(len(hub)) for c in letters}
    docs = [(k, " ".join(sorted(variants | {hub}))) for k in range(5)] + [(9, f"{hub} " * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(df)) == brute(docs)


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (None, "short")], "doc_id long, text string")).collect() == []
