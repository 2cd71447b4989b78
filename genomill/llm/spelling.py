"""Spelling variants: words one edit apart, by dense tiles of common prefixes and suffixes.

Words are runs of letters of the texts, of which a hash deletes one code point in a few. Two words of lengths n and n or
n - 1 are one edit apart exactly if their common prefix and suffix together reach n - 1. Tiles of words are matrices of code
points, filled up on the right for prefixes and on the left for suffixes; rows of a tile are compared a diagonal at a time,
all rows with those so many places on.

Which words share a tile: the longer word's places are cut into `PARTS` parts, and the edit lies in the part of the place
behind the common prefix. So each word is keyed by what is left of it without a part, for each part and for both roles,
as the longer word and as the one shorter by one; near words have that key in common, and the tile reports a pair only in
the part of its edit, hence once. A key of more than `TILE` words is cut into blocks and each pair of blocks is a tile.

A word's form is the near word of largest count if that is ten times its own, and roots are found by doubling: counts grow
tenfold at each step, so a few rounds end every chain.

Defined cases: null text has no words; a null doc_id deletes nothing; repeated rows are documents of their own; equal
counts are told apart by the order of code points; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import release, small, stash, unstash

SHORTEST, LEAST_COUNT, TIMES = 7, 2, 10
DELETED_EVERY = 31
PARTS = 4
#: Words of one key that are compared in one tile, rows of a batch of tiles, and code points of its matrix.
TILE, TOGETHER, CELLS = 1_024, 20_000, 1 << 22
#: Most distinct words that a task counts before it passes the counts on.
REMEMBERED = 200_000
BROADCAST_KEYS = 200_000

# A-Z lower-cased, other letters kept, all else blank; in Latin-1, where code points beyond U+00FF have become '?'
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))


def runs(text: str) -> list[bytes]:
    """The runs of letters A-Z, a-z, U+00C0 to U+00FF in order, lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def edited(doc_id: int | None, run: bytes) -> bytes:
    """The run without one code point, if the hash of document and run says so."""
    if doc_id is None:
        return run
    h = zlib.crc32(b"%d:" % doc_id + (run if run.isascii() else run.decode("latin-1").encode()))
    return run if h % DELETED_EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total: dict[bytes, int] = defaultdict(int)

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for run, n in Counter(runs(text.as_py() or "")).items():
                if len(run) >= SHORTEST:
                    total[edited(doc_id, run)] += n
            if len(total) > REMEMBERED:
                yield told()
    yield told()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least `SHORTEST` code points that occur at least `LEAST_COUNT` times."""
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return sent.mapInArrow(_counting, "word string, n long").where(F.length("word") >= SHORTEST).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def keyed(words: DataFrame) -> DataFrame:
    """size, part, key, word, n: each word without one part of its places, as a word of its own length and as one shorter than `size`."""
    own = F.length("word")
    role = F.explode(F.array(F.lit(0), F.lit(1))).alias("more")
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    each = words.select("*", role).withColumn("size", own + F.col("more")).select("*", part)
    edge = lambda i: F.floor(F.col("size") * i / PARTS).cast("int")
    before, behind = edge(F.col("part")), F.col("size") - edge(F.col("part") + 1)
    rest = F.concat(F.substring(F.col("word"), F.lit(1), before), F.lit("\0"), F.substring(F.col("word"), own - behind + 1, behind))
    return each.select("size", "part", F.xxhash64("size", "part", rest).alias("key"), "word", "n")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading columns the rows of two matrices have in common."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_pairs(words: list[str], size: int, group: np.ndarray, own: np.ndarray, across: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Places i < j of words one edit apart, of which the longer has `size` code points, within each group (equal neighbours in `group`).

    own: the block of each word; across: whether its group holds two blocks, of which only words of different ones are compared.
    part: what the group's key leaves out.
    """
    count = len(words)
    length = np.array([len(w) for w in words])
    left = np.zeros((count, size), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row, first = np.repeat(np.arange(count), length), np.cumsum(length) - length
    column = np.arange(len(flat)) - np.repeat(first, length)
    left[row, column] = flat
    right = np.zeros((count, size), np.uint32)  # suffixes from the last code point on
    right[row, np.repeat(length, length) - 1 - column] = flat
    found, i, step = [], np.arange(count), 0
    while True:
        step += 1
        i = i[i + step < count]
        i = i[group[i] == group[i + step]]
        if not len(i):
            return found
        j = i + step
        fits = ((length[i] == size) | (length[j] == size)) & (~across[i] | (own[i] != own[j]))
        a, b = i[fits], j[fits]
        prefix, suffix = common(left[a], left[b]), common(right[a], right[b])
        near = (prefix + suffix >= size - 1) & (prefix < size)
        at = prefix[near]
        of = part[a[near]]
        right_part = (at >= size * of // PARTS) & (at < size * (of + 1) // PARTS)
        found += zip(a[near][right_part].tolist(), b[near][right_part].tolist(), strict=True)


_LINK = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _tiling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of size, part, key, blocks; whole tiles of one size are compared together."""
    release()
    held: list[tuple] = []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        tiles: dict[tuple, int] = {}
        group = np.array([tiles.setdefault(r[:5], len(tiles)) for r in rows])
        part, low, high, own = (np.array([r[c] for r in rows]) for c in (1, 3, 4, 5))
        pairs = near_pairs([r[6] for r in rows], rows[0][0], group, own, low != high, part)
        both = [(rows[i], rows[j]) for i, j in pairs]
        both += [(b, a) for a, b in both]
        return pa.RecordBatch.from_arrays([pa.array([p[x][c] for p in both], t) for (x, c), t in zip(((0, 6), (0, 7), (1, 6), (1, 7)), _LINK.types, strict=True)], schema=_LINK)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("size", "part", "key", "low", "high", "own", "word", "n")), strict=True):
            if held and (row[0] != held[0][0] or row[:5] != held[-1][:5] and (len(held) >= TOGETHER or len(held) * row[0] > CELLS)):
                yield told(held)
                held = []
            held.append(row)
    if held:
        yield told(held)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words one edit apart."""
    rows = keyed(words)
    large = stash(rows.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > tile).select("key", F.ceil(F.col("words") / tile).alias("blocks")), "large")
    dealt = rows.join(small(large, BROADCAST_KEYS), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("word"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("*", other).select("size", "part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")
    order = ["size", "part", "key", "low", "high"]
    return tiles.repartition("key", "low", "high").sortWithinPartitions(*order).mapInArrow(_tiling, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms (word, form), by doubling the step."""
    at = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stash(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        unstash(at)
        at = step.select("word", "root")
        if not moved:
            return at


def spelling_variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = stash(word_counts(docs), "words")
    # among equal counts the least word: a maximum of the count and then the minimum of the words that have it
    links = stash(near_words(words, tile), "near")
    top = links.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("near_n"), F.first("n").alias("n"), F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"))
    fits = F.col("near_n") >= TIMES * F.col("n")
    best = stash(top.select("word", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "best")
    ends = roots(best.where("form is not null").select("word", "form"))
    return words.join(best, "word", "left").join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
