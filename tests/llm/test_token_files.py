"""Packed token files against the library and exact round trips."""

import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillstone.llm import token_files
from quillstone.llm.token_counts import tokenizer_path

SF = "/root/testdata/sf0.001"


def library(name="byte_bpe_50k.json"):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("bits", [1, 2, 7, 13, 16, 17, 31, 32])
def test_pack(bits):
    random.seed(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = np.array([random.getrandbits(bits) for _ in range(n)], np.uint32)
        packed = token_files.pack(ids, bits)
        assert len(packed) == -(-n // 64) * bits * 8
        assert np.array_equal(token_files.unpack(packed, n, bits), ids)
    assert [token_files.width(v) for v in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


ODD = [
    "", " ", "  \n\n ", "a  b\n\n c", "x<|endoftext|>y", "a  <|endoftext|>  b <|endoftext|>", "it's  we'll 'S", "梦 🙂 ẞ über  12 3,4", "x\x00y \x1c z", "a\x85b \xa0c d", " lead", "trail \t", "tab\tand\x0bvt\x0c ff\r\n",
    "​zero​ width", "'s 't x's", "!? .,;", "a " * 5000, "word" * 3000, " ᠎﻿ x", "1‣2 ¼½ ²", "é ́x",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cuts_are_boundaries(name):
    random.seed(2)
    signs = [" ", "  ", "\n", "\t", "a", "Bc", "é", "9", "'s", "'", "!", "…", "梦", "\x1c", "\xa0", "<|endoftext|>", "́", "🙂", "\r", "\x0b"]
    texts = ODD + ["".join(random.choice(signs) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    t = library(name)
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 7], "<u4").tobytes() for x in texts]
    assert token_files.encoder(tokenizer_path(name), 7)(texts) == want


def brute(docs):
    t, start, out = library(), 0, []
    for d, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in token_files.op11_token_files(spark, SF).collect()) == brute(docs)


def test_many_files_and_random_access(spark, tmp_path):
    docs = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (101, "x " * 40_000), (102, None), (-5, "first")]
    twice = [(200, "again"), (200, "again"), (200, "other")]
    df = spark.createDataFrame([(*r, 1, "i") for r in [*twice, *docs, (None, "last")]], "doc_id long, text string, start int, ids string").repartition(3)
    path = str(tmp_path / "ids")
    token_files.write_ids(df, path, ids_per_file=5_000)
    assert len(list((tmp_path / "ids").glob("*.bits"))) > 5
    got = sorted(token_files.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [*sorted(d for d, _ in [*docs, *twice]), None]
    texts = dict(docs)
    t, at = library(), 0
    whole = []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens) == (at, len(ids))
        if r.doc_id in texts:
            assert ids.tolist() == [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        whole, at = [*whole, *ids.tolist()], at + len(ids)
    random.seed(4)
    for _ in range(60):
        lo, hi = sorted(random.choices(range(len(whole) + 1), k=2))
        assert token_files.ids_between(path, lo, hi).tolist() == whole[lo:hi]


def test_only_committed_files_count(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_ids(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), path)
    (tmp_path / "ids" / "part-000000-lost.bits").write_bytes(b"half a file of a task that was lost")
    assert token_files.read_ids(spark, path).count() == 2
    files = json.loads((tmp_path / "ids" / token_files.MANIFEST).read_text())["files"]
    assert sum(f["n_docs"] for f in files) == 2


def test_ids_beyond_the_vocabulary_are_refused(tmp_path):
    with open(tmp_path / "x", "wb") as out, pytest.raises(ValueError):
        token_files.FileWriter(out, 3).add(1, np.array([8], "<u4"))


def test_token_files_of_empty_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.read_ids(spark, path).collect() == []
    assert len(token_files.ids_between(path, 0, 10)) == 0
