"""Line de-duplication through a sharded minimal perfect hash.

A line's key is the line without white space at both ends, ASCII letters in lower case. Of the keys of at least `MIN_CHARS`
code points, each document sends the 128-bit hashes once; they are counted, with the largest doc_id that holds them. The
hashes of keys in more than one document are dealt to shards; each shard builds a minimal perfect hash (levels of bit
arrays, each key at the first level where no other key hits its bit; ranks by block counts) over arrays of check bits,
counts and last doc_ids. Documents probe the arrays, whose count decides; lines are never joined. The check bits are the 64 bits that the
perfect hash does not use, so a line that isn't indexed passes with probability 2^-64.

While all shards together hold at most `BROADCAST_KEYS` keys, documents probe a broadcast copy. Beyond, the documents' hashes
travel to their shard, which is copied once for every `BLOCK` of them, are probed there one batch at a time, and the hits
return to their documents.

Defined cases: null or empty text is one empty line; rows are documents, also where they repeat or share a doc_id: a key's
lines stay in every row with its largest doc_id, and in rows without doc_id if no row that holds it has one; an empty table
gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import stash, unstash

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 100_000
BROADCAST_KEYS = 2_000_000
#: Lines that are probed against one copy of a shard.
BLOCK = 1_000_000
_MIX, _MASK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


def key_hashes(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """16 bytes of hash of the line's key; None if the key is short."""
    if len(line) < least:
        return None
    key = line.strip(BLANK).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _MIX * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: about 3 bits a key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest  # bits of each level, packed; sorted keys that no level took
        self.ranks, total = [], 0
        for bits in levels:
            counts = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(total + np.concatenate(([0], np.cumsum(counts)[:-1])))
            total += int(counts.sum())
        self.size = total + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 24) -> PerfectHash:
        levels = []
        for level in range(most):
            if not len(keys):
                break
            n = max(64, int(gamma * len(keys)) + 63 & ~63)
            at = (_mixed(keys, level) % np.uint64(n)).astype(np.int64)
            hit = np.bincount(at, minlength=n)
            alone = hit == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; any index, or -1, for keys that weren't built in."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mixed(keys[left], level) % np.uint64(64 * len(bits))).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = ranks[at[here] >> 6] + below[here]
            left = left[~here]
        if len(self.rest) and len(left):
            at = np.searchsorted(self.rest, keys[left]).clip(max=len(self.rest) - 1)
            found = self.rest[at] == keys[left]
            out[left[found]] = self.size - len(self.rest) + at[found]
        return out

    def dump(self) -> list[bytes]:
        return [x.tobytes() for x in self.levels] + [self.rest.tobytes()]

    @classmethod
    def load(cls, parts: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(x, np.uint64) for x in parts[:-1]], np.frombuffer(parts[-1], np.uint64))


class Shard:
    """A perfect hash with its arrays: check bits, counts, last doc_ids (missing: the least integer).

    Keys whose 64 hashed bits are alike (one of 10^9 shards has some) are kept beside it, whole.
    """

    def __init__(self, parts: list[bytes], check: bytes, count: bytes, last: bytes, twins: bytes):
        self.hash = PerfectHash.load(parts)
        self.check, self.count, self.last = np.frombuffer(check, np.uint64), np.frombuffer(count, np.int64), np.frombuffer(last, np.int64)
        rows = np.frombuffer(twins, np.int64).reshape(-1, 4)
        self.twins = {(int(i), int(c)): (int(n), int(d)) for (i, c), (n, d) in zip(rows[:, :2].view(np.uint64), rows[:, 2:], strict=True)}

    def probe(self, index: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many documents each key is (0 if it isn't indexed), and its last doc_id."""
        at = self.hash.find(index)
        known = at >= 0
        known[known] = self.check[at[known]] == check[known]
        count, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[known], last[known] = self.count[at[known]], self.last[at[known]]
        for k in np.flatnonzero(np.isin(index, np.array([i for i, _ in self.twins], np.uint64))) if self.twins else ():
            count[k], last[k] = self.twins.get((int(index[k]), int(check[k])), (0, 0))
        return count, last


def _split(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


NO_ID = np.iinfo(np.int64).min


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = {k for line in (text or "").encode().split(b"\n") if (k := key_hashes(line))}
            keys += own
            ids += [NO_ID if doc_id is None else doc_id] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    index, check = _split(list(rows["key"]))
    n, last = rows["n_docs"].to_numpy(np.int64), rows["last_doc"].to_numpy(np.int64)
    _, first, copies = np.unique(index, return_inverse=True, return_counts=True)
    twin = copies[first] > 1
    table = PerfectHash.build(index[~twin])
    at = table.find(index[~twin])
    arrays = []
    for values in (check, n, last):
        out = np.empty(len(at), values.dtype)
        out[at] = values[~twin]
        arrays.append(out.tobytes())
    twins = np.stack((index[twin].view(np.int64), check[twin].view(np.int64), n[twin], last[twin]), axis=1).astype(np.int64)
    return pd.DataFrame([{"shard": rows["shard"].iloc[0], "parts": table.dump(), "check": arrays[0], "count": arrays[1], "last": arrays[2], "twins": twins.tobytes()}])


def shard_of(index: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(index, 99) % np.uint64(shards)).astype(np.int64)


def _dealt(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            at = shard_of(_split(keys)[0], shards) if keys else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], names=["shard", *batch.schema.names])

    return run


_INDEX = "shard long, parts array<binary>, check binary, count binary, last binary, twins binary"


def build_index(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The shards (shard, parts, check, count, last, twins) of keys in several documents, their number, and the keys'."""
    sent = docs.mapInArrow(_sent, "key binary, doc_id long")
    counted = stash(sent.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).where("n_docs > 1"), "lines")
    keys = counted.count()
    shards = max(1, -(-keys // shard_keys))
    rows = counted.mapInArrow(_dealt(shards), "shard long, key binary, n_docs long, last_doc long")
    index = stash(rows.groupBy("shard").applyInPandas(_build, _INDEX), "index")
    unstash(counted)
    return index, shards, keys


def _probe_all(tables: dict[int, Shard], shards: int, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    index, check = _split(digests)
    count, last = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
    at = shard_of(index, shards)
    for s in np.unique(at):
        mine = at == s
        if int(s) in tables:
            count[mine], last[mine] = tables[int(s)].probe(index[mine], check[mine])
    return count, last


_OUT = "doc_id long, n_lines long, n_dropped long, kept string"
_NAMES = ["doc_id", "n_lines", "n_dropped", "kept"]


def _lines(texts: list, rows: list) -> tuple[list[bytes], list[int], list[int]]:
    """Hashes, row and line number of all long lines of a batch."""
    keys, row, number = [], [], []
    for r, text in zip(rows, texts, strict=True):
        for i, line in enumerate((text or "").encode().split(b"\n")):
            if k := key_hashes(line):
                keys.append(k)
                row.append(r)
                number.append(i)
    return keys, row, number


def _emit(ids: list, texts: list, drop: list) -> pa.RecordBatch:
    n_lines, n_dropped, kept = [], [], []
    for text, gone in zip(texts, drop, strict=True):
        lines = (text or "").split("\n")
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "")
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=_NAMES)


def _probing(shared, shards: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: Shard(*rest) for s, *rest in shared.value}
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            keys, row, number = _lines(texts, range(len(texts)))
            drop = [set() for _ in texts]
            if keys:
                count, last = _probe_all(tables, shards, keys)
                for k in np.flatnonzero(count >= min_docs):
                    if last[k] != (NO_ID if ids[row[k]] is None else ids[row[k]]):
                        drop[row[k]].add(number[k])
            yield _emit(ids, texts, drop)

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        keys, row, number = _lines(batch.column("text").to_pylist(), batch.column("row").to_pylist())
        of = dict(zip(batch.column("row").to_pylist(), ids, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(row, pa.int64()), pa.array(number, pa.int64()), pa.array([NO_ID if of[r] is None else of[r] for r in row], pa.int64())], names=["key", "row", "line", "doc_id"])


def _answering(min_docs: int):
    """Rows in order: a shard, then the lines that ask for it, batch by batch; only the shard is kept in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            is_row, rows, lines = (batch.column(c).to_pylist() for c in ("is_row", "row", "line"))
            out, edges = [], [*(i for i, x in enumerate(is_row) if not x), len(is_row)]
            for a, b in zip([0, *edges], edges + edges[-1:], strict=True):
                if a < b and not is_row[a]:
                    table = Shard(*(batch.column(c)[a].as_py() for c in ("parts", "check", "count", "last", "twins")))
                    a += 1
                if a < b and table is not None:
                    count, last = table.probe(*_split(batch.column("key")[a:b].to_pylist()))
                    gone = (count >= min_docs) & (last != batch.column("doc_id")[a:b].to_numpy(zero_copy_only=False))
                    out += [(rows[a + k], lines[a + k]) for k in np.flatnonzero(gone)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["row", "line"])

    return run


def probed(asked: DataFrame, index: DataFrame, min_docs: int, block: int) -> DataFrame:
    """row, line of the asked keys (shard, key, row, line, doc_id) that go. A shard is shipped once for every `block` lines that ask for it."""
    salts = asked.groupBy("shard").agg(F.ceil(F.count("*") / block).alias("salts"))
    each = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    names = ["shard", "salt", "is_row", "parts", "check", "count", "last", "twins", "key", "row", "line", "doc_id"]
    blank = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in zip(names, ("long", "long", "int", "array<binary>", "binary", "binary", "binary", "binary", "binary", "long", "long", "long"), strict=True)))
    rows = asked.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("row", "line"), "salts"))
    both = blank(each.withColumn("is_row", F.lit(0))).unionByName(blank(rows.withColumn("is_row", F.lit(1))))
    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_row").mapInArrow(_answering(min_docs), "row long, line long")


def _strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _emit(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), [set(x or ()) for x in batch.column("gone").to_pylist()])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_keys: int = BROADCAST_KEYS, shard_keys: int = SHARD_KEYS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the remaining text) of every document; min_docs is 2 at least."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, shards, keys = build_index(docs, shard_keys)
    if keys <= broadcast_keys:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in index.collect()])
        unstash(index)
        return docs.mapInArrow(_probing(shared, shards, min_docs), _OUT)
    docs = stash(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = stash(docs.mapInArrow(_asked, "key binary, row long, line long, doc_id long").mapInArrow(_dealt(shards), "shard long, key binary, row long, line long, doc_id long"), "asked")
    gone = probed(asked, index, min_docs, block).groupBy("row").agg(F.collect_list("line").alias("gone"))
    return docs.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_strike, _OUT)
