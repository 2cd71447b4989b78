"""Filter interaction audit: what five filters remove in each of their 120 orders.

A finite-state transducer over bytes reads every UTF-8 text once. Bytes have classes; its tables give for a state and a
class the next state and what is put out: a code point, a capital, a symbol, the start or the end of a word. The next
state depends on the class alone (white space ends a word, all else is in one), so the tables are applied to a whole batch
of texts at once. Word spans go into an open hash table that compares the bytes of a span with those of the slot's owner
before it calls them equal; a document's occupied slots are its distinct words.

What a document fails is a mask of five bits. Documents of equal text are found by their SHA-256. Counts by part and mask
are then all that is needed: a step's numbers depend on its filter and on the set of filters before it, of which there are
80, and the 120 orders look them up.

Defined cases: null text is empty: no words, no code points; a text without words or code points doesn't fail B or C; a
null or empty lang is the part ''; of several rows of one doc_id none has a smaller doc_id than another; a null doc_id is
neither smaller nor larger than any and has no label; of several labels of one doc_id one of 1 counts, a null label is
none; repeated rows are documents of their own; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import chunks, release, small, stash

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
#: Bytes of text that the tables are applied to at once (a longer text goes alone).
AT_ONCE = 1 << 21
#: Words up to this many bytes are hashed and compared eight bytes at a time for all words together, longer ones each by itself.
SHORT = 64
#: Most texts that occur more than once whose first doc_id is broadcast (about 100 bytes each).
BROADCAST_TEXTS = 100_000

SPACE, CAPITAL, SYMBOL, OTHER, LATER, END = range(6)  # classes; LATER: the second and later bytes of a code point, END: between texts
OUT, IN = range(2)  # states
POINT, UPPER, SIGN, BEGINS, ENDS = 1, 2, 4, 8, 16  # what is put out

CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[ord("A") : ord("Z") + 1] = CAPITAL
CLASS[list(SYMBOLS)] = SYMBOL
CLASS[0x80:0xC0] = LATER
CLASS[0xFF] = END  # no byte of UTF-8

_INNER = (CAPITAL, SYMBOL, OTHER, LATER)
NEXT = np.array([[IN if c in _INNER else OUT for c in range(6)] for _ in (OUT, IN)], np.uint8)
PUT = np.array(
    [
        [(POINT if c not in (LATER, END) else 0) | (UPPER if c == CAPITAL else 0) | (SIGN if c == SYMBOL else 0) | (BEGINS if s == OUT and c in _INNER else 0) | (ENDS if s == IN and c not in _INNER else 0) for c in range(6)]
        for s in (OUT, IN)
    ],
    np.uint8,
)

_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def transduce(buffer: np.ndarray) -> np.ndarray:
    """What the transducer puts out at each byte; it starts out of a word."""
    kind = CLASS[buffer]
    state = np.empty_like(kind)  # before each byte: the state that the byte before leads to, from whichever state
    state[:1] = OUT
    state[1:] = NEXT[OUT][kind[:-1]]
    return PUT.reshape(-1)[state * np.uint8(6) + kind]


class Words:
    """Spans of words in a buffer that ends with eight spare bytes, with the document of each."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray):
        self.buffer, self.start, self.size, self.doc = buffer, start, size, doc
        self.eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))  # the eight bytes from each place on
        self.long = size > SHORT

    def piece(self, word: np.ndarray, at: int) -> np.ndarray:
        """Bytes at .. at + 7 of each word as a number; bytes behind a word's end are 0."""
        return self.eight[self.start[word] + at] & _LOW[np.minimum(self.size[word] - at, 8)]

    def bytes(self, word: int) -> bytes:
        return self.buffer[self.start[word] : self.start[word] + self.size[word]].tobytes()

    def hashes(self) -> np.ndarray:
        h = (self.doc.astype(np.uint64) << np.uint64(20)) + self.size.astype(np.uint64)
        left, at = np.flatnonzero(~self.long), 0
        while len(left):
            x = (h[left] ^ self.piece(left, at)) * _MIX
            h[left] = x ^ x >> np.uint64(29)
            at += 8
            left = left[self.size[left] > at]
        for w in np.flatnonzero(self.long).tolist():
            h[w] ^= np.uint64(xxhash.xxh3_64_intdigest(self.bytes(w)))
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] are of one document and byte for byte the same."""
        same = (self.doc[a] == self.doc[b]) & (self.size[a] == self.size[b])
        left, at = np.flatnonzero(same & (a != b) & ~self.long[a]), 0
        while len(left):
            differ = self.piece(a[left], at) != self.piece(b[left], at)
            same[left[differ]] = False
            at += 8
            left = left[~differ]
            left = left[self.size[a[left]] > at]
        for i in np.flatnonzero(same & (a != b) & self.long[a]).tolist():
            same[i] = self.bytes(a[i]) == self.bytes(b[i])
        return same

    def owners(self) -> np.ndarray:
        """The first word of each document's equal words: every word is put into a free slot or meets its equal there, else goes on to the next."""
        n = len(self.start)
        bits = max(4, int(2 * n).bit_length())
        slots = np.full(1 << bits, -1, np.int64)
        at = (self.hashes() >> np.uint64(64 - bits)).astype(np.int64)
        waiting = np.arange(n)
        while len(waiting):
            free = waiting[slots[at[waiting]] < 0][::-1]
            slots[at[free]] = free  # of several words the first stays
            other = ~self.equal(waiting, slots[at[waiting]])
            waiting = waiting[other]
            at[waiting] = at[waiting] + 1 & (1 << bits) - 1
        return np.sort(slots[slots >= 0])


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """words, distinct, capitals, points, symbols of each UTF-8 text."""
    n = len(texts)
    buffer = np.frombuffer(b"\xff".join(texts) + b"\xff" * 9, np.uint8)
    put = transduce(buffer)
    after = np.cumsum([len(t) + 1 for t in texts])  # behind the byte between texts
    first = after - [len(t) + 1 for t in texts]
    count = lambda bit: np.add.reduceat(put & np.uint8(bit) != 0, first, dtype=np.int64) if n else np.zeros(0, np.int64)
    start, end = np.flatnonzero(put & np.uint8(BEGINS)), np.flatnonzero(put & np.uint8(ENDS))
    doc = np.searchsorted(after, start, side="right")
    owners = Words(buffer, start, end - start, doc).owners()
    return {"words": np.bincount(doc, minlength=n), "distinct": np.bincount(doc[owners], minlength=n), "capitals": count(UPPER), "points": count(POINT), "symbols": count(SIGN)}


def text_mask(c: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3: what the text itself fails of A to D."""
    failed = (c["words"] < LEAST_WORDS, 100 * c["distinct"] < DISTINCT_PERCENT * c["words"], 100 * c["capitals"] > CAPITAL_PERCENT * c["points"], c["symbols"] > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def _masking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part in chunks(batch, AT_ONCE):
            mask = text_mask(text_counts([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]))
            rest = [part.column(c) for c in ("doc_id", "part", "sha")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(mask, pa.int32())], names=["doc_id", "part", "sha", "mask"])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document: bits 0 to 4 for what it fails of A to E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    own = stash(sent.mapInArrow(_masking, "doc_id long, part string, sha binary, mask int"), "masks")
    firsts = own.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    firsts = stash(firsts, "firsts")
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return own.join(small(firsts, BROADCAST_TEXTS), "sha", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(repeats, 4)).alias("mask"))


def audit(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and the counts of that step, for all orders of the filters."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(one("quality"), one("toxic"))
    kinds = masked.join(judged, "doc_id", "left").groupBy("part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("bad")).agg(F.count("*").alias("n"))
    kinds = stash(kinds, "kinds")  # at most 128 rows a part

    n, bit = len(FILTERS), {f: 1 << i for i, f in enumerate(FILTERS)}
    sets = [(sum(bit[x] for x in before), bit[f]) for f in FILTERS for k in range(n) for before in combinations([x for x in FILTERS if x != f], k)]
    case = F.explode(F.array(*(F.struct(F.lit(before).alias("before"), F.lit(own).alias("own")) for before, own in sets)))
    each = kinds.withColumn("case", case).select("*", "case.before", "case.own")
    fails, out = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(0)).alias(name)
    steps = each.groupBy("part", "before", "own").agg(
        total(~fails & ~out, "kept"), total(fails & ~out, "removed"), total(fails & out, "redundant"), total(F.col("mask") == F.col("own"), "unique_fails"), total(fails & ~out & F.col("good"), "good_lost"), total(fails & ~out & F.col("bad"), "toxic_lost"),
    )

    orders: dict[tuple[int, int], list[tuple[str, int]]] = {s: [] for s in sets}
    for order in map("".join, permutations(FILTERS)):
        for i, f in enumerate(order):
            orders[sum(bit[x] for x in order[:i]), bit[f]].append((order, i + 1))
    spots = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.lit(o).alias("o"), F.array(*(F.struct(F.lit(name).alias("filter_order"), F.lit(i).alias("step")) for name, i in found)).alias("found")) for (b, o), found in orders.items())))
    table = masked.sparkSession.range(1, numPartitions=1).select(spots.alias("s")).select(F.col("s.b").alias("before"), F.col("s.o").alias("own"), "s.found")  # 80 rows
    whole = steps.join(F.broadcast(table), ["before", "own"])
    shapley = whole.groupBy("part", "own").agg(F.sum(F.col("removed") * F.size("found")).alias("shapley"))
    return whole.join(F.broadcast(shapley) if _few(kinds) else shapley, ["part", "own"]).withColumn("found", F.explode("found")).select(
        "part", "found.filter_order", "found.step", F.substring(F.col("found.filter_order"), F.col("found.step"), F.lit(1)).alias("filter"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def _few(kinds: DataFrame, rows: int = 1_000_000) -> bool:
    return kinds.count() <= rows


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs), labels)
