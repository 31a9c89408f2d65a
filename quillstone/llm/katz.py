"""Language-model scoring: a Katz backoff model of word bigrams.

P(w) is the Good-Turing discounted share of w, and what the discounts leave is the share of all unknown words together.
P(w | h) is the discounted share of w behind h where training texts have the pair, and otherwise a(h) P(w); a(h) is what
the discounts leave behind h over the share of the words never seen behind h, so that each distribution sums to one.

Documents are packed into blocks of tokens, kept in a table that is bucketed by block. A block asks for the counts of its
distinct words and pairs: sorted 64-bit keys go to parts of the key space, which sum the counts over all blocks and reply
in the order of the keys. So the tables of counts are stored partitioned by key, every pair crosses the network once for
each block that has it, however frequent it is, and no table is held whole. The sums that backoff weights need are gathered
likewise, by the one block that owns a pair. The tables stay: ``score_with`` scores other documents from them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, shared_dir, table, written
from .suffixes import Hashes, mixed

#: Counts up to CUT are discounted; tokens of a block; tokens of the corpus for each part of the key space.
CUT, BLOCK, PART = 5, 1_000_000, 2_000_000
START, END = 2, 1
_C = np.uint64(0x9E3779B97F4A7C15)
STATE = "block long, n_tokens long, vocabulary binary, tokens binary, pieces binary, doc_ids array<long>"


def pack(a: np.ndarray) -> bytes:
    """An array in bytes, each byte of its numbers by itself, which compresses well."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.compress(a.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.decompress(b)
    kind = np.dtype(raw[:4].decode().strip())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts in Katz's form for counts 0 to CUT; n[r]: how many types have count r, to CUT + 1.

    Where the counts of counts are too few for a discount between nought and one, half a count is taken off.
    """
    out = np.ones(CUT + 1)
    tail = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= CUT, d[np.minimum(c, CUT)], 1.0)


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """Documents as blocks. pieces: for each piece of a document its number, tokens, whether it is for training, whether it is the last."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        hashes = Hashes()
        part = TaskContext.get().partitionId() << 33
        number, made = 0, 0
        seqs: list[np.ndarray] = []
        pieces: list[tuple] = []
        ids: list = []
        held = 0

        def flush():
            # the end is in every vocabulary: its count is that of the training texts
            vocabulary, tokens = np.unique(np.concatenate([*seqs, np.array([END], np.uint64)]), return_inverse=True)
            return pa.RecordBatch.from_pydict({"block": [part + made], "n_tokens": [len(tokens)], "vocabulary": [pack_sorted(vocabulary)], "tokens": [pack(tokens[:-1].astype(np.uint32))], "pieces": [pack(np.array(pieces, np.int64).ravel())], "doc_ids": pa.array([ids], pa.list_(pa.int64()))}, schema=kind)

        kind = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("vocabulary", pa.binary()), ("tokens", pa.binary()), ("pieces", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
        for b in batches:
            for doc_id, text, train in zip(*(c.to_pylist() for c in b.columns)):
                seq = np.concatenate([np.array([START], np.uint64), hashes(WORD.findall(lower_ascii(text or ""))), np.array([END], np.uint64)])
                for lo in range(0, len(seq) - 1, block):
                    piece = seq[lo : lo + block + 1]
                    seqs.append(piece)
                    pieces.append((part + number, len(piece), train, lo + block >= len(seq) - 1))
                    ids.append(doc_id)
                    held += len(piece)
                    if held >= block:
                        yield flush()
                        seqs, pieces, ids, held, made = [], [], [], 0, made + 1
                number += 1
        if held:
            yield flush()

    return docs.mapInArrow(run, STATE)


class Block:
    """A block in arrays: words by local number, for each token its piece, its history and whether it counts for training."""

    def __init__(self, row: dict):
        self.vocabulary = unpack_sorted(row["vocabulary"])
        seq = unpack(row["tokens"]).astype(np.int64)
        pieces = unpack(row["pieces"]).reshape(-1, 4)
        self.number, size, self.train, _ = pieces.T
        first = np.cumsum(size) - size
        inside = np.ones(len(seq), bool)
        inside[first] = False
        at = np.flatnonzero(inside)
        self.piece = np.repeat(np.arange(len(size)), size)[at]
        self.token, self.history = seq[at], seq[at - 1]
        self.counted = self.train[self.piece].astype(bool)
        key = mixed(self.vocabulary[self.history] * _C + self.vocabulary[self.token])
        self.pairs, self.first, self.pair = np.unique(key, return_index=True, return_inverse=True)

    def counts(self) -> np.ndarray:
        return np.bincount(self.token[self.counted], minlength=len(self.vocabulary))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.counted], minlength=len(self.pairs))


def sliced(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of the key space cut sorted keys."""
    edges = np.array([k * 2**64 // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(block: int, kind: str, keys: np.ndarray, values: list[np.ndarray], parts: int):
    cut = sliced(keys, parts)
    for p in range(parts):
        lo, hi = cut[p], cut[p + 1]
        if hi > lo:
            yield kind, p, block, pack_sorted(keys[lo:hi]), b"" if not values else pack(values[0][lo:hi]), b"" if len(values) < 2 else pack(values[1][lo:hi])


ASKED = "kind string, part int, block long, keys binary, x binary, y binary"


def _asked(state: DataFrame, rows, parts: int) -> DataFrame:
    """Requests of all blocks; ``rows`` gives the (kind, keys, values) of one."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ASKED))

    def run(batches):
        for b in batches:
            for row in (r for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
                for kind, keys, values in rows(row):
                    made = list(requests(row["block"], kind, keys, values, parts))
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return state.mapInArrow(run, ASKED)


#: A reply to a block; or, without a block, what a part holds: its keys, one or two columns of values, and counts of counts.
REPLIED = "kind string, part int, block long, reply binary, keys binary, x binary, y binary, stats array<long>"
HELD = ["kind", "part", "keys", "x", "y", "stats"]


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of a part's keys over all blocks. A reply holds 2 c, plus 1 where the block owns the key."""
    group = group.sort_values("block")
    keys = [unpack_sorted(k) for k in group["keys"]]
    every = np.concatenate(keys)
    found, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([unpack(x) for x in group["x"]]), len(found)).astype(np.int64)
    reply = 2 * total[inverse]
    reply[first] += 1
    cut = np.cumsum([len(k) for k in keys])[:-1]
    kind, part = group["kind"].iloc[0], group["part"].iloc[0]
    of = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
    out = [(kind, part, b, pack(r), None, None, None, None) for b, r in zip(group["block"], np.split(reply, cut))]
    known = total > 0  # what only texts that aren't for training have is no part of the model
    out.append((kind, part, None, None, pack_sorted(found[known]), pack(total[known]), None, [*of.tolist()[: CUT + 2], int(total.sum()), int(known.sum())]))
    return pd.DataFrame(out, columns=[f.split()[0] for f in REPLIED.split(", ")])


def _weigh(group: pd.DataFrame) -> pd.DataFrame:
    """Sums what blocks have of each history: discounted counts and shares of its followers. A reply holds both."""
    group = group.sort_values("block")
    keys = [unpack_sorted(k) for k in group["keys"]]
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(inverse, np.concatenate([unpack(x) for x in group[c]]), len(found)) for c in ("x", "y")]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    kind, part = group["kind"].iloc[0], group["part"].iloc[0]
    out = [(kind, part, b, pack(np.concatenate(z)), None, None, None, None) for b, *z in zip(group["block"], *(np.split(s[inverse], cut) for s in sums))]
    known = sums[0] > 0
    out.append((kind, part, None, None, pack_sorted(found[known]), *(pack(s[known]) for s in sums), None))
    return pd.DataFrame(out, columns=[f.split()[0] for f in REPLIED.split(", ")])


def _looked_up(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Replies to blocks of other documents from what a part of the tables holds; a key that it lacks has noughts."""
    columns = [f.split()[0] for f in REPLIED.split(", ")]
    if not len(asked):
        return pd.DataFrame([], columns=columns)
    kind, part = asked["kind"].iloc[0], asked["part"].iloc[0]
    empty = not len(held) or held["keys"].iloc[0] is None
    keys = np.zeros(0, np.uint64) if empty else unpack_sorted(held["keys"].iloc[0])
    values = [np.zeros(0, np.int64 if kind != "history" else float)] * 2 if empty else [unpack(held[c].iloc[0]) for c in ("x", "y") if held[c].iloc[0] is not None]

    def of(wanted, value):
        if not len(keys):
            return np.zeros(len(wanted), value.dtype)
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, value[place], 0)

    out = []
    for b, k in zip(asked["block"], asked["keys"]):
        wanted = unpack_sorted(k)
        reply = np.concatenate([of(wanted, v) for v in values]) if kind == "history" else 2 * of(wanted, values[0])
        out.append((kind, part, b, pack(reply), None, None, None, None))
    return pd.DataFrame(out, columns=columns)


def _reply(row: dict, kind: str) -> np.ndarray:
    return np.concatenate([unpack(r["reply"]) for r in sorted((r for r in row["replies"] if r["kind"] == kind), key=lambda r: r["part"])])


def _with_replies(state: DataFrame, replies: DataFrame) -> DataFrame:
    collected = replies.filter("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "reply")).alias("replies"))
    return state.join(collected.hint("merge"), "block")


class Model:
    """What a block knows after the replies: counts of its words and pairs, and the discounts."""

    def __init__(self, row: dict, stats: dict[str, list[int]]):
        self.block = Block(row)
        words, pairs = stats["word"], stats["pair"]
        self.total, self.types = words[CUT + 2], words[CUT + 3]
        self.d1, self.d2 = discounts(words), discounts(pairs)
        known = sum(self.d1[r] * r * words[r] for r in range(1, CUT + 1)) + self.total - sum(r * words[r] for r in range(1, CUT + 1))
        self.unknown = (self.total - known) / self.total if self.total else 1.0
        self.c = _reply(row, "word") >> 1
        pair = _reply(row, "pair")
        self.pair_c, self.owned = pair >> 1, (pair & 1).astype(bool)
        #: Shares of words; an unknown word has the share of all unknown words.
        self.share = np.where(self.c > 0, discounted(self.c, self.d1) / max(self.total, 1), self.unknown)
        #: Tokens behind each word as a history: each training text has one start and one end.
        ends = self.c[self.block.vocabulary == END][0]
        self.behind = np.where(self.block.vocabulary == START, ends, np.where(self.block.vocabulary == END, 0, self.c))

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """By history, the discounted counts and the shares of the followers in pairs that the block owns."""
        b = self.block
        at = np.flatnonzero(self.owned & (self.pair_c > 0))
        h, w = b.history[b.first[at]], b.token[b.first[at]]
        n = len(b.vocabulary)
        return np.bincount(h, discounted(self.pair_c[at], self.d2), n), np.bincount(h, self.share[w], n)

    def scores(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each pair of the block, and of the base model of each word."""
        b = self.block
        kept, followed = np.split(np.concatenate([x for x in self._sums(row)]), 2)
        whole = kept >= self.behind  # no follower is discounted: one more token stands for the words never seen
        behind = np.maximum(self.behind + whole, 1)
        left = np.where(self.behind > 0, (behind - kept) / behind, 1.0)
        weight = left / np.maximum(1.0 - np.where(self.behind > 0, followed, 0.0), 1e-12)
        h, w = b.history[b.first], b.token[b.first]
        p = np.where(self.pair_c > 0, discounted(self.pair_c, self.d2) / behind[h], weight[h] * self.share[w])
        return np.log10(np.maximum(p, 1e-300)), np.log10((self.c + 0.5) / (self.total + 0.5 * (self.types + 1)))

    def _sums(self, row: dict):
        parts = [np.split(unpack(r["reply"]), 2) for r in sorted((r for r in row["replies"] if r["kind"] == "history"), key=lambda r: r["part"])]
        return [np.concatenate(x) for x in zip(*parts)]


@dataclass
class Tables:
    """A model: its counts and sums by (kind, part of the key space), each row with the sorted keys of the part and their values, and counts of counts.

    kind: word and pair (x: counts), history (x: discounted counts of its followers, y: their shares). ``held`` is a written
    table, partitioned by kind; it and ``stats`` (some twenty numbers) are all that scoring needs.
    """

    held: DataFrame
    parts: int
    stats: dict[str, list[int]]


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _scored_blocks(state: DataFrame, replies: DataFrame, stats: dict, name: str) -> DataFrame:
    """number, doc_id, n_tokens, n_known, base_score and score of the documents of blocks that have all their replies."""

    def last(batches):
        import pyarrow as pa

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                m = Model(row, stats)
                b = m.block
                score, base = m.scores(row)
                n = len(b.number)
                yield pa.RecordBatch.from_pydict({
                    "number": b.number, "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": np.bincount(b.piece, minlength=n), "n_known": np.bincount(b.piece, m.c[b.token] > 0, n).astype(np.int64),
                    "base_score": np.bincount(b.piece, base[b.token], n), "score": np.bincount(b.piece, score[b.pair], n),
                })

    pieces = _with_replies(state, replies).mapInArrow(last, "number long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = pieces.groupBy("number").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    out = written(out, name)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(stats["word"][CUT + 2]).cast("long").alias("train_tokens"), "base_score", "score")


class _Stored:
    """The blocks of documents as a table in the shared folder, bucketed by block, so that replies alone are shuffled; its name goes at the end, failed or not."""

    def __init__(self, docs: DataFrame, train, block: int):
        self.spark, self.name = docs.sparkSession, f"katz_blocks_{uuid.uuid4().hex}"
        self.rows = blocks(docs.select("doc_id", "text", train.alias("train")), block)

    def __enter__(self) -> DataFrame:
        try:
            self.rows.write.option("path", f"{shared_dir(self.spark)}/{self.name}").bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(self.name)
        except BaseException:
            self.__exit__()
            raise
        return self.spark.table(self.name)

    def __exit__(self, *_):
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def modelled(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Tables]:
    """The scores of ``docs`` (see ``scored``) and the tables of the model that their training part gives."""
    with _Stored(docs, ~held_out(F.col("doc_id")), block) as state:
        tokens = state.agg(F.sum("n_tokens")).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // PART + 1)

        def first(row):
            b = Block(row)
            yield "word", b.vocabulary, [b.counts()]
            yield "pair", b.pairs, [b.pair_counts()]

        counted = written(_asked(state, first, parts).groupBy("kind", "part").applyInPandas(_count, REPLIED), "counts", ["kind"])
        stats = {"word": [0] * (CUT + 4), "pair": [0] * (CUT + 4)}
        sums = counted.filter("stats IS NOT NULL").groupBy("kind").agg(*(F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(CUT + 4)))
        stats |= {r["kind"]: list(r)[1:] for r in sums.collect()}

        def second(row):
            m = Model(row, stats)
            yield "history", m.block.vocabulary, list(m.sums())

        weighed = written(_asked(_with_replies(state, counted), second, parts).groupBy("kind", "part").applyInPandas(_weigh, REPLIED), "weights", ["kind"])
        every = counted.unionByName(weighed)
        return _scored_blocks(state, every, stats, "scores"), Tables(every.filter("block IS NULL").select(*HELD), parts, stats)


def score_with(tables: Tables, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The scores of any documents (doc_id, text) by a model that is there already; columns and cases as ``scored`` has them."""

    def asked(row):
        b = Block(row)
        yield "word", b.vocabulary, []
        yield "pair", b.pairs, []
        yield "history", b.vocabulary, []

    with _Stored(docs, F.lit(False), block) as state:
        requests_ = _asked(state, asked, tables.parts).groupBy("kind", "part")
        replies = written(requests_.cogroup(tables.held.select("kind", "part", "keys", "x", "y").groupBy("kind", "part")).applyInPandas(_looked_up, REPLIED), "replies")
        return _scored_blocks(state, replies, tables.stats, "scores")


def scored(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of ``docs`` (doc_id, text).

    The model learns from the documents whose crc32(doc_id as text) mod 5 is not 1 (a null doc_id counts as empty text).
    A null text is empty: its one token is the end. Repeated rows are counted and scored each. Where there is nothing to
    learn from, all words are unknown; an empty table gives no rows. Texts longer than a block are scored in pieces that
    are summed. Other columns of ``docs`` are neither read nor returned. Words are told apart by 64-bit hashes: two of n
    different words share one with a chance below n * n / 2 ** 65, a millionth for five million words.
    """
    return modelled(docs, block)[0]


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
