"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for every piece that spells a stretch of it, weighted with the piece's score (in this
vocabulary its rank, negated: early merges weigh more), and for each character that no piece spells its bytes, at a
penalty. A forward pass finds the best score from the start to each place (and the second best to the end); a backward
A* search from the end then takes these scores as its heuristic, which is exact, so that it pops segmentations in the
order of their scores and never expands a place that none of the N best goes through.

No piece has a space mark behind another character, so the lattice of a text is a chain of those of its words (each with
the marks before it) and newlines. The N best of the text differ from its best in at most N - 1 words, which are among the N - 1
with the least loss from best to second best; only these are searched, and their lists are merged by a heap.
"""

from __future__ import annotations

import heapq
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, table

MARK = "▁"
BEST = 4
#: Loss of a character that is spelled in bytes, below the least score of any piece.
PENALTY = 10.0
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stretches that pieces may go over: a word with the marks before it, or a newline.
SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class Pieces:
    """A vocabulary as a lattice needs it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.spelled: list[bytes] = []
        self.byte = [0] * 256
        # pieces that merges never reach have a score out of all range; here they are as good as the last merge
        floor = min(x for k in range(sp.get_piece_size()) if (x := sp.get_score(k)) > -1e8)
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            self.spelled.append(b"")
            if sp.is_byte(k):
                self.byte[int(piece[1:-1], 16)] = k
                self.spelled[k] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.ids[piece], self.score[piece] = k, max(sp.get_score(k), floor)
                self.spelled[k] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.score.values()) - PENALTY
        #: Beginnings of pieces: the score of those that are pieces themselves. Scores are never above nought.
        self.begun: dict[str, float | None] = {}
        for piece in self.ids:
            for k in range(1, len(piece)):
                self.begun.setdefault(piece[:k], None)
        self.begun |= {p: min(s, 0.0) for p, s in self.score.items()}
        self.score = {p: min(s, 0.0) for p, s in self.score.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p[:-1] or "\n" in p[1:] for p in self.ids):
            raise ValueError("a piece goes over the start of a word or a newline")
        #: Words met before: when there are too many the older half goes.
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def forward(self, word: str) -> tuple[list[float], list[int], float]:
        """Best score to each place, where the best last edge begins, and the second best score to the end."""
        n, get, score, unknown = len(word), self.begun.get, self.score, self.unknown
        low = float("-inf")
        best, back, second = [low] * (n + 1), [0] * (n + 1), [low] * (n + 1)
        best[0] = 0.0
        for begin in range(n):
            b, r, end = best[begin], second[begin], begin + 1
            s = score.get(word[begin], unknown)
            while True:
                if s is not None:
                    s0 = b + s
                    if s0 > best[end]:
                        s1 = r + s
                        second[end] = best[end] if best[end] > s1 else s1
                        best[end], back[end] = s0, begin
                    elif s0 > second[end]:
                        second[end] = s0
                end += 1
                if end > n:
                    break
                s = get(word[begin:end], 1.0)
                if s == 1.0:
                    break
        return best, back, second[n]

    def edge(self, text: str) -> tuple[int, ...]:
        k = self.ids.get(text)
        return (k,) if k is not None else tuple(self.byte[b] for b in text.encode("utf-8", "replace"))

    def word(self, word: str) -> tuple[float, float, tuple[int, ...]]:
        """Best score, loss of the second best and the ids of the best segmentation."""
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            best, back, second = self.forward(word)
            ids, at, known = [], len(word), self.ids
            while at:
                k = known.get(word[back[at] : at])
                ids += (k,) if k is not None else self.edge(word[back[at] : at])[::-1]
                at = back[at]
            found = best[-1], best[-1] - second, tuple(reversed(ids))
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations by backward A* from the end; of equal scores those met first.

        As the heuristic is exact, every open way stands for a segmentation with just its score: only as many of them are
        kept open as are still wanted. A way is the link of its last cut to the way it comes from.
        """
        best, _, _ = self.forward(word)
        score, longest, out, met = self.score.get, self.longest, [], 0
        # (negated score of the best segmentation through here, number, place, score from here to the end, way to the end)
        ways: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], 0, len(word), 0.0, None)]
        while ways and len(out) < n:
            rank, _, end, after, way = ways.pop(0)
            if end == 0:
                ids, at = [], 0
                while way is not None:
                    ids += self.edge(word[at : way[0]])
                    at, way = way
                out.append((-rank, tuple(ids)))
                continue
            way, wanted = (end, way), n - len(out)
            for begin in range(max(0, end - longest), end):
                s = score(word[begin:end])
                if s is None:
                    if begin < end - 1:
                        continue
                    s = self.unknown
                rank = -(best[begin] + s + after)
                if len(ways) < wanted or rank < ways[-1][0]:
                    met += 1
                    insort(ways, (rank, met, begin, s + after, way))
                    del ways[wanted:]
        return out

    def encode(self, text: str, n: int = BEST) -> tuple[list[int], list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]:
        """The ids of the best segmentation; the scores of the n best, and for each the words (by number) in which it isn't the best, with their ids."""
        words = SEGMENT.findall(normalised(text))
        ids, total, get = [], 0.0, self.known.get
        # the n - 1 words that lose least by their second best segmentation
        near: list[tuple[float, int]] = []
        most = float("inf")
        for k, w in enumerate(words):
            found = get(w)
            if found is None:
                found, get = self.word(w), self.known.get
            score, loss, own = found
            total += score
            ids += own
            if loss < most:
                insort(near, (loss, k))
                if len(near) >= n:
                    near.pop()
                if len(near) == n - 1:
                    most = near[-1][0] if near else 0.0
        lists = []
        for _, k in near:
            found = self.search(words[k], n)
            lists.append((k, [(found[0][0] - s, own) for s, own in found]))
        merged: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for _, found in lists:
            merged = heapq.nsmallest(n, ((a + loss, (*c, j)) for a, c in merged for j, (loss, _) in enumerate(found)))
        return ids, [(total - loss, [(lists[i][0], lists[i][1][j][1]) for i, j in enumerate(choice) if j]) for loss, choice in merged]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the mark that was put before it is taken away again."""
        text = b"".join([self.spelled[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def normalised(text: str) -> str:
    """Spaces as marks, and one mark before the text; an empty text stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


@lru_cache(4)
def load(path: str) -> Pieces:
    return Pieces(path)


def encoded(docs: DataFrame, path: str | None = None, n: int = BEST) -> DataFrame:
    """doc_id, ids, scores, variants and round_trip, a row for each row of ``docs`` (doc_id, text).

    ids: of the best segmentation. scores: of the n best, from the best down (fewer where a text has fewer). variants:
    for each, the words (by number from 0) that are segmented otherwise than in the best, with their ids. round_trip:
    whether decoding ids gives the text back; the space mark itself decodes to a space. A null text is empty: no ids and
    the one score nought. Repeated rows are alike; other columns of ``docs`` are neither read nor returned.
    """
    path = path or model_path()
    variant = T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("variants", T.ArrayType(variant)), T.StructField("round_trip", T.BooleanType())]

    def rows(texts: list[str | None]) -> Iterator[tuple]:
        pieces = load(path)
        for text in texts:
            text = text or ""
            ids, found = pieces.encode(text, n)
            yield ids, [s for s, _ in found], [[{"word": k, "ids": list(v)} for k, v in changes] for _, changes in found], pieces.decode(ids) == text.replace(MARK, " ")

    return add_columns(docs.select("doc_id", "text"), "text", fields, rows).drop("text")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encodings of all documents."""
    found = encoded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.size("scores").cast("long").alias("n_best"), F.transform("scores", lambda s: F.round(s, 3)).alias("scores"), F.xxhash64("variants").alias("variants_hash"), "round_trip")
