"""Token-id files: canonical length-limited Huffman codes in independent blocks.

Layout. A file is a table of blocks (part, seq, first_doc, last_doc, n_docs, n_ids, payload), in ascending doc_id order by
(part, seq), and one code book. The code book holds the code length of every id, at most `MAX_BITS`; codes are canonical (by length, then id). It is
made from the counts of all ids by package-merge. A payload is self-contained (all integers little-endian):

    4 bytes  b"TKH1"            uint32  number of documents     uint64  number of ids      uint32  ids between checkpoints
    int64    doc_id of each document        uint8   1 where doc_id is null
    uint32   ids of each document
    uint64   bit offset of every checkpoint: of ids 0, step, 2 * step, ...
    bytes    the codes, most significant bit first, padded with zero bits and 4 zero bytes

Decoding looks up `MAX_BITS` bits at a time in a table (id, length); all checkpoints of a block advance together.

Defined cases: null text counts as empty and still gets its end id; rows with equal doc_id are ordered by text, null doc_id
come last; very long texts make long blocks, never several; an empty table gives an empty file; other columns aren't read.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.llm.common import chunks, held, scratch, slices, stash, unstash

MAX_BITS, STEP, BLOCK_IDS, END_ID = 16, 512, 500_000, 2
#: Most blocks whose numbers are broadcast to place them.
PLACES = 1_000_000
#: Strings that a worker meets before it forgets those met longest ago.
REMEMBERED = 400_000
#: Bytes of text whose ids are held at once (a longer text goes alone).
AT_ONCE = 1 << 21
MAGIC = b"TKH1"


class _Mapped(dict):
    """Each character as byte-level models spell it."""

    def __init__(self):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.level = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, c: int) -> str:
        self[c] = self.level.pre_tokenize_str(chr(c))[0][0]
        return self[c]


#: The pre-tokenizer's classes of letters and numbers among the characters that `_ODD` lets through.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_ODD = re.compile("[^\\t\\n\\r -~\u00a1-\u024f\u2010-\u2027\u2030-\u205e]")


class _Memo(dict):
    """Ids of pieces by the library's model; the pieces met longest ago are forgotten."""

    def __init__(self, model, mapped: _Mapped):
        super().__init__()
        self.cut, self.mapped, self.blank, self.old = model.tokenize, mapped, mapped[32], {}
        self.two = [i.to_bytes(2, "little") for i in range(1 << 16)]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            spelled = piece.replace(" ", self.blank) if piece.isascii() and piece.isprintable() else piece.translate(self.mapped)
            two = self.two
            ids = b"".join([two[t.id] for t in self.cut(spelled)])
        self[piece] = ids
        return ids

    def tidy(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of pieces.

    Texts of Latin letters, numbers and marks are cut by the byte-level pre-tokenizer's pattern; the library's model turns
    each piece into ids, once for as long as it is remembered. Texts with other characters, where Unicode versions might cut
    differently, or with an added token's string go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = _Memo(self.tokenizer.model, _Mapped())

    def encode(self, texts: list[str]) -> list[bytes]:
        """uint16 ids of each text."""
        return [self._encode(text) for text in texts]

    def _encode(self, text: str) -> bytes:
        if _ODD.search(text) or any(t in text for t in self.added):
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        ids = b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))
        self.memo.tidy(self.remembered)
        return ids


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of every id with a count, by package-merge: optimal among prefix codes of at most `limit` bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit in {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # each level: leaves and packages of the level below, by weight; only how many of the first are leaves is kept
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate((leaf, packages))
        by = np.argsort(weights, kind="stable")
        levels.append(by < len(leaf))
        merged = weights[by]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[0::2] + merged[1::2]
    take, lengths = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        size = self.lengths[order]
        steps = 1 << (MAX_BITS - size)
        first = np.concatenate(([0], np.cumsum(steps)[:-1])) if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = first >> (MAX_BITS - size)
        self.table = np.zeros((1 << MAX_BITS, 2), np.int64)
        filled = np.repeat(np.arange(len(order)), steps)
        self.table[: len(filled), 0], self.table[: len(filled), 1] = order[filled], size[filled]

    def pack(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """The codes of `ids` as bytes, and the bit offset of every `step`-th id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        total = int(end[-1]) if len(end) else 0
        # a code of up to 16 bits touches at most three bytes; neighbours never share a bit, so sums are unions
        shifted = self.codes[ids].astype(np.int64) << (24 - size - (start & 7))
        out = np.zeros(total // 8 + 8, np.int64)
        for k in range(3):
            out[: total // 8 + 5] += np.bincount((start >> 3) + k, (shifted >> (16 - 8 * k)) & 255, minlength=total // 8 + 5)[: total // 8 + 5].astype(np.int64)
        return out[: (total + 7) // 8 + 4].astype(np.uint8).tobytes(), start[::step].astype(np.uint64)

    def unpack(self, data: bytes, offsets: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        raw = np.concatenate((raw, np.zeros(4, np.int64)))
        window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]  # three bytes from each place
        lanes = len(offsets)
        out, at = np.zeros((step, lanes), np.uint16), offsets.astype(np.int64)
        ids, size = np.ascontiguousarray(self.table[:, 0]).astype(np.uint16), np.ascontiguousarray(self.table[:, 1])
        last = n - (lanes - 1) * step  # ids of the last lane
        for k in range(step if lanes > 1 else last):
            if k == last:
                at = at[:-1]
            peek = window[at >> 3] >> (8 - (at & 7)) & 0xFFFF
            out[k, : len(at)] = ids[peek]
            at = at + size[peek]
        return out.T.reshape(-1)[:n] if lanes else np.zeros(0, np.uint16)


def write_block(doc_ids: list, ids: list[np.ndarray], code: Code, step: int = STEP) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    data, offsets = code.pack(flat.astype(np.int64), step)
    head = struct.pack("<4sIQI", MAGIC, len(ids), len(flat), step)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + names + np.array([len(x) for x in ids], "<u4").tobytes() + offsets.astype("<u8").tobytes() + data


def read_block(payload: bytes, code: Code) -> tuple[list, list[np.ndarray]]:
    magic, docs, n, step = struct.unpack_from("<4sIQI", payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize("<4sIQI")
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    missing = payload[at + 8 * docs : at + 9 * docs]
    sizes = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    lanes = -(-n // step)
    offsets = np.frombuffer(payload, "<u8", lanes, at)
    flat = code.unpack(payload[at + 8 * lanes :], offsets, n, step) if n else np.zeros(0, np.uint16)
    return [None if m else int(d) for d, m in zip(doc_ids, missing, strict=True)], np.split(flat, np.cumsum(sizes)[:-1]) if docs else []


def _encoding(path: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("encoder", path, remembered), lambda: Encoder(path, remembered))
        gc.disable()  # nothing here makes cycles, and the memo has many small objects
        end = np.array([END_ID], np.uint16).tobytes()
        for batch in (part for b in batches for part in chunks(b, AT_ONCE)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array([x + end for x in encoder.encode(texts)], pa.binary())], names=["doc_id", "tie", "ids"])
        gc.enable()

    return run


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16), minlength=1 << 16)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])


_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
_BLOCK_DDL = "part int, seq int, first_doc long, last_doc long, n_docs long, n_ids long, payload binary"


def _writing(lengths: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = Code(np.frombuffer(lengths, np.uint8)), TaskContext.get().partitionId(), 0
        docs, ids, size = [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "first_doc": docs[0], "last_doc": docs[-1], "n_docs": len(docs), "n_ids": size, "payload": write_block(docs, ids, code)}], schema=_BLOCK)

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc_id)
                ids.append(np.frombuffer(own, np.uint16))
                size += len(ids[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    docs, ids, size, seq = [], [], 0, seq + 1
        if docs:
            yield block()

    return run


def encode_documents(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, tie (orders rows of one doc_id), ids (uint16, with the end id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encoding(path, remembered), "doc_id long, tie long, ids binary")


def write_tokens(encoded: DataFrame, folder: str) -> None:
    """Writes blocks (table `blocks`) and the code book (table `code`) under `folder`, through Spark's writers."""
    spark = encoded.sparkSession
    counts = encoded.select("ids").mapInArrow(_counting, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(1 << 16, np.int64)
    for i, n in counts.collect():  # 65,536 rows at most
        total[i] = n
    lengths = code_lengths(total).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").write.parquet(f"{folder}/code")
    order = F.col("doc_id").asc_nulls_last()
    ordered = encoded.repartitionByRange(slices(encoded), order).sortWithinPartitions(order, "tie", "ids")
    ordered.mapInArrow(_writing(lengths), _BLOCK_DDL).write.option("compression", "none").parquet(f"{folder}/blocks")


def _reading(lengths: bytes, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, ids = read_block(payload.as_py(), code)
                size = np.array([len(x) for x in ids], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                columns = [pa.array(doc_ids, pa.int64()), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes() for x in ids], pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it in the file), n_tokens, ids_crc32 (and ids as uint16) of every document in the file."""
    lengths = bytes(spark.read.parquet(f"{folder}/code").first()[0])
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")  # one row of two numbers a written partition
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    places = sizes.withColumn("within", within).join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + F.col("within")).alias("start"))
    places = F.broadcast(places) if blocks.count() <= PLACES else places
    found = blocks.select("part", "seq", "payload").join(places, ["part", "seq"]).select("start", "payload")
    return found.mapInArrow(_reading(lengths, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file(docs: DataFrame, path: str, folder: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes, writes to `folder` (default: a new one in the shared folder) and reads the file back. remembered: strings a worker keeps in mind (300 bytes each)."""
    folder = folder or f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    encoded = stash(encode_documents(docs, path, remembered), "ids")
    write_tokens(encoded, folder)
    unstash(encoded)
    return read_tokens(docs.sparkSession, folder)
