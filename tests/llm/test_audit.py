"""The filter audit against brute force: every order walked document by document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quillstone.llm import audit

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, part string, mask int, n long, word string"
LABELS = "doc_id long, quality int, toxic int, text string"


def documents():
    prose = " ".join(f"word{k}" for k in range(60))
    return [
        (1, prose, "a"), (2, prose, "a"), (3, prose, "b"), (3, prose, "b"), (None, prose, "a"), (None, prose, None), (4, "the " * 80, "a"), (5, "THE CAT " * 30, "b"),
        (6, None, "a"), (7, "", None), (7, "", ""), (8, " \t\n\x0b", "a"), (9, prose + " #", "b"), (9, prose + " other", "b"), (10, "über ÄB   \x1c \x85 梦 🙂 x\x00y " * 20, "c"), (11, prose.upper(), "b"), (0, prose, "c"),
        (12, " ".join(f"w{k % 40000}" for k in range(60_000)), "c"),
    ]


def brute(docs, labels):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in docs]
    ids = {}
    for d, t, _ in docs:
        if d is not None:
            ids.setdefault(t or "", []).append(d)
    failed = []
    for (d, t, _), w in zip(docs, words):
        t = t or ""
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and min(ids[t]) < d}
        failed.append({k for k, v in f.items() if v})
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    out = {}
    for p in {s or "" for *_, s in docs}:
        own = [(d, f) for (d, _, s), f in zip(docs, failed) if (s or "") == p]
        first = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                first[x] += len(gone)
                fails = [r for r in own if x in r[1]]
                out[p, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(f == {x} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (q, order, k), row in out.items():
            if q == p:
                row.append(first[order[k - 1]])
    return out


def rows_of(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in df.collect()}


@pytest.mark.parametrize("block", [1, 300, audit.BLOCK])
def test_audit(spark, block):
    docs, labels = documents(), [(1, 1, 0), (4, 0, 1), (5, 1, 1), (5, 0, None), (5, None, None), (None, 1, 1), (99, 1, 1), (9, 1, 0)]
    got = audit.filter_audit(spark.createDataFrame([(*r, "p", 1, 2, "w") for r in docs], SCHEMA), spark.createDataFrame([(*r, "t") for r in labels], LABELS), block)
    assert rows_of(got) == brute(docs, labels)


def test_audit_of_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(audit.op13_audit(spark, SF)) == brute(docs, labels)


def test_matrix(spark):
    rows = [(k, "p", t) for k, (_, t, _) in enumerate(documents())]
    df = spark.createDataFrame(rows, "doc_id long, part string, text string").repartition(3)
    shards, words = audit.document_term_matrix(df, 200)
    term = {r.word: r.term for r in words.collect()}
    assert sorted(term.values()) == list(range(len(term)))
    want = {d: Counter(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, _, t in rows}
    assert set(term) == {w for row in want.values() for w in row}
    got = {}
    for r in shards.collect():
        starts, terms, counts = (np.frombuffer(x, k) for x, k in ((r.starts, np.int64), (r.terms, np.int64), (r.counts, np.int32)))
        got |= {d: dict(zip(terms[a:e].tolist(), counts[a:e].tolist())) for d, a, e in zip(r.doc_ids, starts, starts[1:])}
    assert got == {d: {term[w]: n for w, n in c.items()} for d, c in want.items()}
    assert {r.doc_id: (r.n_words, r.n_distinct) for r in audit.word_counts(df, 200).collect()} == {d: (c.total(), len(c)) for d, c in want.items()}


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audit.filter_audit(none, spark.createDataFrame([], LABELS)).collect() == []
    assert len(audit.filter_audit(spark.createDataFrame([(1, None, None, "p", 1, 2, "w")], SCHEMA), spark.createDataFrame([], LABELS)).collect()) == 600
