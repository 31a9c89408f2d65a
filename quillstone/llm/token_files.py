"""Token ids in files of fixed-width bits, as a Spark data source.

A file holds the ids of documents one after another. Ids have as many bits as the vocabulary needs and are packed into blocks
of BLOCK ids, little-endian, 64 ids to as many 64-bit words as an id has bits; the index behind the blocks has the place of
each block, and the number and the end of each document. So any ids are found by a division and unpacked by numpy, a block at
a time. Files follow each other in the order of the partitions written; a manifest names those of the tasks that committed,
with their ids and documents, so that files of tasks that failed or ran twice are never read.

    df.write.format("token_bits").option("vocabulary", 50257).save(path)      # doc_id, ids (binary, unsigned 32-bit little-endian)
    df.write.format("token_bits").option("vocabulary", 50257).option("tokenizer", file).option("end", 2).save(path)     # doc_id, text
    spark.read.format("token_bits").load(path)                                # doc_id, start, n_tokens, ids
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import shared_dir, slices, table
from .token_counts import load, tokenizer_path

MAGIC, MANIFEST = b"TOKBITS1", "manifest.json"
#: Ids of a block (a multiple of 64), of a file and of a batch that is read; the id that ends a document.
BLOCK, IDS_PER_FILE, BATCH, END = 1 << 14, 16_000_000, 1 << 20, 2
#: Bytes of text for an id, below what any text has, to tell how many files there will be.
BYTES_PER_ID = 2
_FOOT = struct.Struct("<6q8s")
_IDS = np.dtype("<u4")


def width(vocabulary: int) -> int:
    """The bits that ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; up to 63 are added to fill the last words."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits), "<u8")
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.tobytes()


def unpack(packed: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of ``pack``'s bytes."""
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, k] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, k] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out.reshape(-1)[:n] & np.uint64((1 << bits) - 1)).astype(_IDS)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and its place there; any that pyarrow knows, the local one for a path without a scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+://", path) else (pafs.LocalFileSystem(), os.path.abspath(path))


class FileWriter:
    """Packs documents as they come: at most one block of ids is held, and the index."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.held, self.n_held, self.at = [], 0, 0
        self.blocks, self.numbers, self.ends = [], [], []
        self.n_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self._put(pack(ids, self.bits))

    def add(self, number: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id of document {number} has more than {self.bits} bits")
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.numbers.append(number)
        self.ends.append(self.n_ids)
        if self.n_held >= BLOCK:
            every = np.concatenate(self.held)
            whole = len(every) // BLOCK * BLOCK
            for lo in range(0, whole, BLOCK):
                self._flush(every[lo : lo + BLOCK])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        index = self.at
        known = np.array([n is not None for n in self.numbers], np.uint8)
        for a, kind in ((self.blocks, "<i8"), ([n or 0 for n in self.numbers], "<i8"), (self.ends, "<i8"), (known, np.uint8)):
            self._put(np.array(a, kind).tobytes())
        self.out.write(_FOOT.pack(self.bits, BLOCK, len(self.blocks), len(self.numbers), self.n_ids, index, MAGIC))


class FileReader:
    """A file of packed ids: its documents, and the ids from one place to another."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - _FOOT.size)
        self.bits, self.block, n_blocks, n_docs, self.n_ids, index, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        source.seek(index)
        raw = source.read(8 * n_blocks + 17 * n_docs)
        self.blocks = np.frombuffer(raw, "<i8", n_blocks)
        self.numbers, self.ends = (np.frombuffer(raw, "<i8", n_docs, 8 * n_blocks + k * 8 * n_docs) for k in (0, 1))
        self.known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_blocks + 16 * n_docs).astype(bool)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to before ``hi`` of the file: only the blocks that have them are read."""
        out = []
        for b in range(lo // self.block, -(-hi // self.block) if hi > lo else 0):
            n = min(self.block, self.n_ids - b * self.block)
            self.source.seek(int(self.blocks[b]))
            own = unpack(self.source.read(-(-n // 64) * self.bits * 8), n, self.bits)
            out.append(own[max(0, lo - b * self.block) : hi - b * self.block])
        return np.concatenate(out) if out else np.zeros(0, _IDS)


@dataclass
class Written(WriterCommitMessage):
    """A task's file: its partition, name, ids and documents."""

    partition: int
    name: str
    n_ids: int
    n_docs: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, tokenizer: str | None, end: int):
        self.path, self.bits, self.tokenizer, self.end = path, width(vocabulary), tokenizer, end

    def ids(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The ids of a batch's rows: those of its texts, if there is a tokenizer."""
        if self.tokenizer is not None:
            run = of_worker(self.tokenizer, self.end)
            for part in slices(batch.column("text"), TOGETHER):
                yield from (np.frombuffer(ids, _IDS) for ids in run(part.to_pylist()))
        else:
            for ids in batch.column("ids"):
                own = ids.as_buffer()
                yield np.frombuffer(own, _IDS) if own is not None else np.zeros(0, _IDS)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.bits"
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            file = FileWriter(out, self.bits)
            for batch in iterator:
                for number, ids in zip(batch.column("doc_id").to_pylist(), self.ids(batch)):
                    file.add(number, ids)
            file.close()
        return Written(partition, name, file.n_ids, len(file.numbers))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted((asdict(m) for m in messages if m is not None), key=lambda m: m["partition"])
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"bits": self.bits, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class Part(InputPartition):
    """A file and how many ids there are in the files before it."""

    name: str
    start: int


def manifest(path: str) -> list[tuple[Part, int]]:
    """The files of a folder in order, with the number of their ids."""
    fs, root = file_system(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as source:
        files = json.loads(source.read())["files"]
    starts = np.concatenate([[0], np.cumsum([f["n_ids"] for f in files], dtype=np.int64)])
    return [(Part(f["name"], int(s)), f["n_ids"]) for f, s in zip(files, starts)]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        # without files there is one part of no rows, as a reader has to have one
        return [p for p, _ in manifest(self.path)] or [Part("", 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        if not part.name:
            return
        fs, root = file_system(self.path)
        with fs.open_input_file(f"{root}/{part.name}") as source:
            file = FileReader(source)
            begin = np.concatenate([[0], file.ends])[:-1].astype(np.int64)
            lo = 0
            while lo < len(begin):
                hi = max(lo + 1, int(np.searchsorted(file.ends, begin[lo] + BATCH, "right")))
                base = int(begin[lo])
                raw = file.ids(base, int(file.ends[hi - 1]))
                ids = [raw[int(b) - base : int(e) - base].tobytes() for b, e in zip(begin[lo:hi], file.ends[lo:hi])]
                numbers = pa.array(file.numbers[lo:hi], pa.int64(), mask=~file.known[lo:hi])
                yield pa.RecordBatch.from_arrays([numbers, pa.array(begin[lo:hi] + part.start), pa.array(file.ends[lo:hi] - begin[lo:hi]), pa.array(ids, pa.binary())], schema=schema)
                lo = hi


class TokenBits(DataSource):
    """``token_bits``: see the module. Options: path; for writing vocabulary (ids are below it), and tokenizer and end, to write texts."""

    @classmethod
    def name(cls) -> str:
        return "token_bits"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["vocabulary"]), self.options.get("tokenizer"), int(self.options.get("end", END)))


def ids_between(path: str, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to before ``hi`` of all that a folder holds, from the blocks that have them."""
    fs, root = file_system(path)
    out = [np.zeros(0, _IDS)]
    for part, n in manifest(path):
        if part.start < hi and lo < part.start + n:
            with fs.open_input_file(f"{root}/{part.name}") as source:
                out.append(FileReader(source).ids(max(0, lo - part.start), min(n, hi - part.start)))
    return np.concatenate(out)


#: What a text is cut into: letters with the white space before them, if an ASCII sign other than a letter comes next; else all
#: up to white space. No piece of a byte-level pre-tokenizer goes from a letter on to such a sign, or from any sign on to white
#: space, and where one begins all that follows depends on the text from there on, so that the cuts are boundaries of its pieces.
CUT = re.compile(r"[ \t-\r]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f]|\Z)|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+\Z")
#: White space of which the two sides' ideas could differ: texts that have it are encoded in one go. Cuts that a worker remembers,
#: bytes of text whose cuts are looked at together, and cuts that are encoded at once.
OTHER_SPACE, REMEMBERED, TOGETHER, AT_ONCE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"), 600_000, 4 << 20, 1_000


def encoder(path: str, end: int):
    """A function that gives texts' ids with ``end`` behind them, as bytes. The library encodes each different cut once for a call; the first ones are remembered.

    That holds for tokenizers without a normalizer whose pre-tokenizer is the byte-level one with its own pattern; others,
    and texts with unusual white space, have every text encoded whole.
    """
    t = load(path)
    pre = t.pre_tokenizer
    plain = all(not (a.lstrip or a.rstrip) and re.fullmatch(r"[\x00-@\[-`{-\x7f]\S*", a.content) for a in t.get_added_tokens_decoder().values())
    cuts = plain and t.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
    remembered: dict[str, bytes] = {}
    last = array("I", [end]).tobytes()

    def encode(texts: list[str]) -> Iterator[bytes]:
        for lo in range(0, len(texts), AT_ONCE):
            for e in t.encode_batch_fast(texts[lo : lo + AT_ONCE], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [last] * len(texts)
        cut, whole = {}, []
        for k, text in enumerate(texts):
            if cuts and not OTHER_SPACE.search(text or ""):
                cut[k] = CUT.findall(text or "")
            else:
                whole.append(k)
        for k, ids in zip(whole, encode([texts[k] or "" for k in whole])):
            out[k] = ids + last
        fresh = list(set().union(*cut.values()).difference(remembered))
        room = max(0, REMEMBERED - len(remembered))
        remembered.update(zip(fresh, encode(fresh)))
        for k, row in cut.items():
            out[k] = b"".join(map(remembered.__getitem__, row)) + last
        for c in fresh[room:]:
            del remembered[c]
        return out

    return run


_ENCODERS: dict[tuple[str, int], object] = {}


def of_worker(path: str, end: int):
    """The encoder, once for each Python worker."""
    return _ENCODERS.get((path, end)) or _ENCODERS.setdefault((path, end), encoder(path, end))


def write_ids(docs: DataFrame, to: str, path: str | None = None, end: int = END, ids_per_file: int = IDS_PER_FILE) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to the folder ``to``, in the order of doc_id, null last.

    Rows that repeat a doc_id are in the order of a hash of their texts, and may be in several files, as all are where a
    doc_id repeats very often; rows that repeat both are alike. A null text has the end id alone. Texts may be of any length.
    Other columns aren't read. Files have about ``ids_per_file`` ids; an empty table has none.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenBits)
    path = path or tokenizer_path()
    own = docs.select("doc_id", "text")
    total = own.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    files = 1 + ((total[0] or 0) // BYTES_PER_ID + total[1]) // ids_per_file
    keyed = own.select(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text")
    order = ["none", "doc_id", "hash", "row"]
    placed = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    vocabulary = max(load(path).get_vocab_size(with_added_tokens=True), end + 1)
    placed.write.format("token_bits").mode("append").option("vocabulary", vocabulary).option("tokenizer", path).option("end", end).save(to)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of the documents in a folder."""
    spark.dataSource.register(TokenBits)
    return spark.read.format("token_bits").load(path)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
