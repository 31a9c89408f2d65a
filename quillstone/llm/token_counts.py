"""Token counts with overlap resynchronisation.

Short documents are encoded whole. A huge one is encoded in overlapping chunks. The library parts a text into pieces from
left to right before it merges inside them, and where a piece begins the rest of the parting depends on the text from
there on alone. A place at which both the chunk on the left and that on the right begin a piece is therefore a stable
boundary, if the left chunk has seen enough text beyond it; the chunks are spliced at the last such place. Where there is
none, the overlap is widened until there is one or the chunk takes in the rest of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_columns, table

#: Characters above which a text is encoded in chunks, of a chunk and of the first overlap.
HUGE, CHUNK, OVERLAP = 16_000, 16_000, 1_000
#: Characters beyond a boundary that a chunk must have seen: more than the longest special string, and the look-ahead.
MARGIN = 64
LIMIT = 1024
BATCH_CHARS = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}


def load(path: str):
    """The library's tokenizer, once for each Python worker. Truncation and padding are off."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def pieces(encoded, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, in characters of the text, and the number of tokens before each."""
    words = np.array([-1 if w is None else w for w in encoded.word_ids], np.int64)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    # a special string is a piece by itself, and its neighbours' numbers start anew
    first = np.ones(len(words), bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    at = np.flatnonzero(first)
    return offsets[at, 0] + base, at


def count_chunked(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> tuple[int, int]:
    """Tokens of ``text`` from encodings of overlapping chunks, and the number of chunks; ``encode`` takes a text and gives the library's encoding.

    Offsets inside a piece may be those of one character that several tokens share; pieces begin between characters.
    """
    total, begin, chunks = 0, 0, 1
    while True:
        end = min(len(text), begin + chunk)
        left = encode(text[begin:end])
        if end == len(text):
            return total + len(left), chunks
        at, before = pieces(left, begin)
        wide = overlap
        while True:
            start = max(begin + 1, end - wide)
            sure = (at > start) & (at <= end - margin)
            if sure.any():
                stop = min(len(text), end + margin)
                right, _ = pieces(encode(text[start:stop]), start)
                common = np.flatnonzero(sure & np.isin(at, right))
                if len(common):
                    k = common[-1]
                    total, begin, chunks = total + int(before[k]), int(at[k]), chunks + 1
                    break
            if start == begin + 1:  # no stable boundary in the chunk at all: a longer chunk from the same place
                chunk *= 2
                break
            wide *= 2


def counts(texts: list[str | None], path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """For each text its tokens and the number of chunks in which it was encoded."""
    t = load(path)
    encode = lambda x: t.encode(x, add_special_tokens=False)
    held: list[str] = []
    size = 0

    def flush():
        yield from ((len(e), 1) for e in t.encode_batch_fast(held, add_special_tokens=False))

    for text in texts:
        text = text or ""
        if len(text) > huge:
            yield from flush()
            held, size = [], 0
            yield count_chunked(encode, text, chunk, overlap)
            continue
        held.append(text)
        size += len(text)
        if size > BATCH_CHARS:
            yield from flush()
            held, size = [], 0
    yield from flush()


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chunks, a row for each row of ``docs``.

    path: of a tokenizers file. n_chunks: in how many chunks the text was encoded. A null text is empty: no bytes, no tokens. Repeated rows count alike; other columns of
    ``docs`` are neither read nor returned. Special strings inside texts count as the library's default has them.
    """
    path = path or tokenizer_path()

    def rows(texts):
        for text, (n, chunks) in zip(texts, counts(texts, path, huge, chunk, overlap)):
            yield len((text or "").encode()), n, n > limit, chunks

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_chunks", T.LongType())]
    return add_columns(docs.select("doc_id", "text"), "text", fields, rows).drop("text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
