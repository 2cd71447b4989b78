"""Near-duplicate groups by BagMinHash.

A document is the multiset of its runs of `SHINGLE` words. Its signature has `WIDTH` components: for every shingle there is
a Poisson process of points (time, weight level, component); a component's value is the earliest point among the levels
below the shingle's weight. Components of two documents agree with a probability equal to their weighted Jaccard likeness.
Weights are counts, so levels are unit steps; they are gathered into intervals [0,1), [1,2), [2,4), [4,8), ... whose
processes are drawn whole, and only the interval that a weight cuts through drops points above it: a shingle that occurs n times costs log n
draws. Points later than a bound are not drawn; if a component stays empty, the bound is doubled.

Documents with equal word sequences are one class from the start, by a digest. Signatures of the others are cut into `BANDS`
bands; documents that share a band are candidates. In each bucket all are compared with its lowest document, by exact multiset
overlap. A bucket whose other documents then still lie in several groups is resolved exactly: those outside the largest of
these groups are compared with all of them, blocks against blocks, so that a task holds one block whatever the bucket's size.
Links of likeness `THRESHOLD` or more are closed to groups by rounds of minimum labels. Only documents that share a bucket
have their shingles written, made a second time from their texts.

The chance that a pair of likeness 0.8 shares no band is (1 - 0.8^5)^36 = 6e-7.

Defined cases: words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased; a text of fewer words
than a shingle is one shingle; texts without words (also null) have no links and are groups of their own; rows are
documents, repeated rows fall into one group; null doc_id is allowed; an empty table gives no rows; other columns are not read by `near_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm.common import chunks, release, small, stash, unstash, unused

SHINGLE, WIDTH, BANDS, THRESHOLD = 5, 180, 36, 0.8
#: Likeness estimates below this don't come from a pair of likeness 0.8 (five standard deviations: 3e-7).
ESTIMATE = 0.65
#: Most rows, and about the most bytes, of a bucket's block that one task holds.
BLOCK, BLOCK_BYTES = 4_000, 16_000_000
#: Bytes of text whose words a worker holds at once.
CHUNK = 1_000_000
#: Most rows of one or two numbers each that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_KEEP = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _add(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles: 40-bit hashes in ascending order and counts of all texts, and where each text's begin (one more than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    width = np.minimum(sizes, SHINGLE)
    n = np.maximum(sizes - SHINGLE + 1, sizes > 0)
    owner = np.repeat(np.arange(len(texts)), n)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    total = np.zeros(len(owner), np.uint64)
    short = (width < SHINGLE).any()
    for k in range(SHINGLE):
        if short:
            inside = k < width[owner]
            total[inside] = _mix(_add(total[inside], 1) ^ h[at[inside] + k])
        else:
            total = _mix(_add(total, 1) ^ h[at + k])
    keys = np.sort(owner.astype(np.uint64) << _U(40) | total >> _U(24))
    new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(keys)))
    bounds = np.searchsorted(keys[first], np.arange(len(texts) + 1, dtype=np.uint64) << _U(40))
    return keys[first] & _U((1 << 40) - 1), counts, bounds


def _uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(items: np.ndarray, weights: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A row of 32-bit components for each multiset: hashes of their earliest points. An empty multiset has zeros."""
    texts = len(bounds) - 1
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    mass = np.bincount(owner, weights=weights, minlength=texts)
    first, value = np.full(texts * width, np.inf), np.zeros(texts * width, np.uint64)
    bound = (np.log(width) + 3.0) / np.maximum(mass, 1)
    todo = mass > 0
    while todo.any():
        level, size = 0, 1  # the interval [level, level + size)
        pick = todo[owner]
        own, weight, of = items[pick], weights[pick], owner[pick]
        while len(own):
            _points(_mix(_add(own, 2 + level)), weight, of, level, size, width, bound, first, value)
            level, size = (1, 1) if not level else (2 * level, 2 * level)
            more = weight > level
            own, weight, of = own[more], weight[more], of[more]
        todo &= np.isinf(first.reshape(texts, width)).any(axis=1)
        bound *= 2
    return np.where(mass[:, None] > 0, (_mix(value) >> _U(32)).reshape(texts, width), 0).astype(np.uint32)


def _points(state: np.ndarray, weight: np.ndarray, of: np.ndarray, level: int, size: int, width: int, bound: np.ndarray, first: np.ndarray, value: np.ndarray) -> None:
    """Points of one interval's processes up to the bound. A process's points follow from its state and their number."""
    rate = width * size
    state = _mix(_add(state, 1))
    live = _uniform(state) > np.exp(-rate * bound)[of]  # the first point comes before the bound
    state, weight, of = state[live], weight[live], of[live]
    point, time, whose = state, -np.log(_uniform(state)) / rate, np.arange(len(state))
    drawn, reached = np.ones(len(state), np.int64), time
    while len(point):
        place = _mix(_add(point, 3))
        inside = weight[whose] >= level + size
        if size > 1:
            inside |= level + size * _uniform(_mix(_add(point, 5))) < weight[whose]
        c = of[whose[inside]] * width + ((place[inside] >> _U(32)) * _U(width) >> _U(32)).astype(np.int64)
        t, v = time[inside], place[inside]
        np.minimum.at(first, c, t)
        earliest = t == first[c]
        value[c[earliest]] = v[earliest]
        # as many further points at once as are expected before the bound
        more = reached < bound[of]
        state, weight, of, drawn, reached = state[more], weight[more], of[more], drawn[more], reached[more]
        n = np.ceil(rate * (bound[of] - reached)).astype(np.int64)
        whose = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        number = np.arange(len(whose)) - begin[whose] + drawn[whose]
        with np.errstate(over="ignore"):
            point = _mix(state[whose] + _U(0x9E3779B97F4A7C15) * (number + 7).astype(np.uint64))
        steps = np.cumsum(-np.log(_uniform(point)) / rate)
        before = steps[begin - 1] if len(begin) else steps
        time = reached[whose] + steps - np.where(begin > 0, before, 0.0)[whose]
        drawn, reached = drawn + n, time[begin + n - 1] if len(begin) else reached
        kept = time < bound[of[whose]]
        point, time, whose = point[kept], time[kept], whose[kept]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two multisets."""
    small, large = sorted((int(a[1].sum()), int(b[1].sum())))
    if small < THRESHOLD * large:
        return small / large  # an upper bound, below the threshold
    total = small + large
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0


def _packed(items: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """40 bits of each hash in sorted order, and the places and counts of those above one."""
    many = np.flatnonzero(counts > 1)
    return np.ascontiguousarray(items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), np.stack((many, counts[many])).astype(np.uint32).tobytes()


def _unpacked(items: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(items) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(items, np.uint8).reshape(-1, 5)
    counts = np.ones(len(out), np.int64)
    at, n = np.frombuffer(many, np.uint32).reshape(2, -1)
    counts[at] = n
    return out.view("<u8").ravel(), counts


_SIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.binary()), ("buckets", pa.list_(pa.int64()))])
_SIGNED_DDL = "row long, doc_id long, tag long, key binary, buckets array<long>"
_BODY = pa.schema([("key", pa.binary()), ("own", pa.list_(pa.int64())), ("sketch", pa.binary()), ("items", pa.binary()), ("many", pa.binary())])
_BODY_DDL = "key binary, own array<long>, sketch binary, items binary, many binary"


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list, tuple, np.ndarray]]:
    """Parts of the batches with the key, the multisets (items, counts, bounds) and the signature of each of their texts."""
    release()
    for batch in batches:
        for part in chunks(batch, CHUNK):
            sequences = [words(t) for t in part.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(b" ".join(s)) if s else None for s in sequences]
            found = shingles(sequences)
            yield part, keys, found, signatures(*found, width)


def _buckets(sigs: np.ndarray, bands: int) -> pa.Array:
    """The bucket of each band of each signature; the band's number is part of it."""
    cut = sigs.reshape(len(sigs), bands, sigs.shape[1] // bands).astype(np.uint64)
    state = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2])
    for k in range(cut.shape[2]):
        state = _mix(_add(state, 1) ^ cut[:, :, k])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * bands), pa.array(state.ravel().view(np.int64)))


def _signing(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, _, sigs in _signed(batches, width):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "tag")), pa.array(keys, pa.binary()), _buckets(sigs, bands)], schema=_SIGNED)

    return run


def _bodying(bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, (items, counts, bounds), sigs in _signed(batches, width):
            packed = [_packed(items[a:b], counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [x.tobytes() for x in sigs.astype(np.uint8)], [x[0] for x in packed], [x[1] for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _buckets(sigs, bands), *(pa.array(c, pa.binary()) for c in columns)], schema=_BODY)

    return run


def bodies_of(docs: DataFrame, needed: DataFrame, bands: int, width: int) -> DataFrame:
    """row, own (its buckets), sketch (8 bits of each component), items, many of the needed rows (row, tag, key).

    They are made a second time from the texts: few documents share a bucket, so the shingles of the others are never
    written or moved. The tag picks the texts; the key, made anew, makes sure of them.
    """
    tags = needed.select("tag").distinct()
    made = docs.join(small(tags, BROADCAST_ROWS), "tag", "left_semi").select("text").mapInArrow(_bodying(bands, width), _BODY_DDL)
    return stash(made.join(small(needed.select("key", "row"), BROADCAST_ROWS), "key").drop("key").dropDuplicates(["row"]), "bodies")


def _alike(a: bytes, b: bytes) -> bool:
    """Whether the sketches leave it possible that the likeness reaches the threshold."""
    return (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() >= ESTIMATE


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*((x.as_py() for x in c) for c in batch.columns), strict=True)


def _pairs(found: list, names: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=list(names))


def _verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: a head's body, then the rows that are held against it; only the head is kept in memory."""
    found, head = [], ()
    for of, _, is_row, row, sketch, items, many in _rows(batches):
        if not is_row:
            head = of, sketch, _unpacked(items, many)
        elif _alike(head[1], sketch) and likeness(head[2], _unpacked(items, many)) >= THRESHOLD:
            found.append((of, row))
            if len(found) == 10_000:
                yield _pairs(found)
                found = []
    yield _pairs(found)


def verified(pairs: DataFrame, bodies: DataFrame, block: int) -> DataFrame:
    """The pairs (head, row) whose likeness reaches the threshold, as links a, b.

    A head with many rows is salted: its body is shipped once for every `block` rows, never with each of them.
    """
    heads = pairs.groupBy("head").agg(F.ceil(F.count("*") / block).alias("salts"))
    body = "sketch", "items", "many"
    each = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).withColumn("row", F.col("head")).join(bodies, "row").select("head", "salt", F.lit(0).alias("is_row"), "row", *body)
    rows = pairs.join(heads, "head").withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).join(bodies, "row").select("head", "salt", F.lit(1).alias("is_row"), "row", *body)
    return each.unionByName(rows).repartition("head", "salt").sortWithinPartitions("head", "salt", "is_row").mapInArrow(_verifying, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """row, least: the lowest row that each linked row is connected with, by rounds of minimum labels with shortcuts."""
    both = stash(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "links")
    labels = stash(both.groupBy(F.col("x").alias("row")).agg(F.least(F.min("y"), F.col("row")).alias("least")), "labels")
    while True:
        heard = both.join(labels, both.y == labels.row).groupBy(F.col("x").alias("row")).agg(F.min("least").alias("heard"))
        told = labels.join(heard, "row", "left").select("row", F.col("least").alias("old"), F.least("least", "heard").alias("least"))
        # a shortcut: each label's own label
        roots = told.select(F.col("row").alias("least"), F.col("least").alias("root"))
        step = stash(told.join(roots, "least", "left").select("row", "old", F.least("least", "root").alias("least")), "labels")
        changed = step.where("old <> least").limit(1).count()
        unstash(labels)
        labels = step
        if not changed:
            unstash(both)
            return labels.select("row", "least")


class _Groups:
    """Union-find over the group ids of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _resolving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: a block of a bucket's members, then queries that are held against it, one at a time; only the block is kept.

    Two rows are compared in the first of the buckets that hold both, two queries of one bucket once, and rows that are
    already in one group not at all. The sketches pick what is compared; the multisets decide.
    """
    at, members, sketches, groups, found = None, [], None, _Groups(), []
    for bucket, part, turn, is_query, outer, row, least, own, sketch, items, many in _rows(batches):
        if at != (bucket, part, turn):
            at, members, sketches, groups = (bucket, part, turn), [], None, _Groups()
        if not is_query:
            members.append((row, least, outer, own, sketch, items, many))
            continue
        if not members:
            continue
        if sketches is None:
            sketches = np.frombuffer(b"".join(m[4] for m in members), np.uint8).reshape(len(members), -1)
            rows, outers, owns = (np.array([m[k] for m in members]) for k in (0, 2, 3))
        near = np.flatnonzero((sketches == np.frombuffer(sketch, np.uint8)).mean(axis=1) >= ESTIMATE)
        mine = np.array(own)
        near = near[(mine[(owns[near] == mine).argmax(axis=1)] == bucket) & (~outers[near] | (rows[near] > row))]
        unpacked = None
        for j in near.tolist():
            group = members[j][1]
            if groups.find(least) != groups.find(group):
                unpacked = unpacked or _unpacked(items, many)
                if likeness(unpacked, _unpacked(*members[j][5:])) >= THRESHOLD:
                    found.append((row, members[j][0]))
                    groups.join(least, group)
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def resolved(buckets: DataFrame, labels: DataFrame, bodies: DataFrame, block: int) -> DataFrame:
    """Links inside the buckets whose documents lie in several groups: those outside a bucket's largest group against all of it.

    Every block of a bucket's rows meets every block of its queries, in order, in `_resolving`.
    """
    placed = stash(buckets.join(labels, "row", "left").withColumn("least", F.coalesce("least", "row")), "placed")
    sizes = placed.groupBy("bucket", "least").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "least")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("bucket", F.col("top.least").alias("main"))
    mixed = placed.join(main, "bucket")
    # buckets that hold the same documents are one: that of the first band, so that it stays the first for each of its pairs
    same = mixed.groupBy("bucket").agg(F.min("band").alias("band"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("s2"), F.count("*").alias("n"))
    once = same.groupBy("s1", "s2", "n").agg(F.min_by("bucket", "band").alias("bucket")).select("bucket")
    mixed = stash(mixed.join(once, "bucket", "left_semi").select("bucket", "row", "least", "main"), "mixed")
    is_query = F.col("least") != F.col("main")
    held = mixed.join(bodies, "row")
    weight = F.sum(F.length("items") + F.length("many") + F.length("sketch"))
    totals = stash(held.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(weight / BLOCK_BYTES)).alias("parts"), F.ceil(F.count_if(is_query) / block).alias("turns")).where("turns > 0"), "totals")
    sized = held.join(small(totals, BROADCAST_ROWS), "bucket")
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("row"), c)
    members = sized.withColumn("part", place("parts")).withColumn("turn", count("turns")).withColumn("is_query", F.lit(0))
    queries = sized.where(is_query).withColumn("turn", place("turns")).withColumn("part", count("parts")).withColumn("is_query", F.lit(1))
    key = "bucket", "part", "turn"
    both = members.unionByName(queries).select(*key, "is_query", is_query.alias("outer"), "row", "least", "own", "sketch", "items", "many")
    found = stash(both.repartition(*key).sortWithinPartitions(*key, "is_query").mapInArrow(_resolving, "a long, b long"), "near")
    unstash(placed, mixed, totals)
    return found


def near_groups(docs: DataFrame, bands: int = BANDS, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the lowest doc_id of the group) and class_size of every document.

    Copies of one word sequence are represented by one row, so a group of copies is as cheap as one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("doc_id", "text"))
    signed = stash(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_signing(bands, width), _SIGNED_DDL), "signed")
    plain = signed.select("row", "doc_id", "tag", "key")
    texts = stash(plain.where("key is not null").groupBy("key").agg(F.min("row").alias("rep")), "texts")
    each = signed.join(small(texts.select(F.col("rep").alias("row")), BROADCAST_ROWS), "row", "left_semi").select("row", F.posexplode("buckets").alias("band", "bucket"))
    heads = stash(each.groupBy("bucket").agg(F.min("row").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head"), "heads")
    buckets = stash(each.join(small(heads, BROADCAST_ROWS), "bucket"), "buckets")
    needed = stash(plain.join(small(buckets.select("row").distinct(), BROADCAST_ROWS), "row", "left_semi").select("row", "tag", "key"), "needed")
    bodies = bodies_of(docs, needed, bands, width)
    pairs = stash(buckets.where("row <> head").select("head", "row").distinct(), "pairs")
    links = stash(verified(pairs, bodies, block), "near")
    labels = components(links)
    more = resolved(buckets.where("row <> head").select("band", "bucket", "row"), labels, bodies, block)  # all were compared with the head
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    roots = texts.join(labels.withColumnRenamed("row", "rep"), "rep", "left").select("key", F.coalesce("least", "rep").alias("root"))
    placed = stash(plain.join(roots, "key", "left").select("row", "doc_id", "tag", F.coalesce("root", "row").alias("root")), "groups")
    classes = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).getField("row").alias("first_row"))
    unstash(signed, texts, heads, buckets, needed, bodies, pairs, links, labels, more)
    return placed.join(classes, "root").select("doc_id", "tag", "class_id", "class_size", (F.col("row") == F.col("first_row")).alias("is_first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the lowest doc_id, with all its columns.

    Kept documents are found by doc_id and a hash of doc_id and text, so texts needn't travel; where several rows share
    both, one of them is kept.
    """
    key, nth = unused(docs) + "key", unused(docs) + "nth"
    found = near_groups(docs).withColumn(key, F.struct(F.col("doc_id").alias("id"), "tag"))
    kept = stash(found.groupBy(key).agg(F.max("is_first").alias("first"), F.count("*").alias("n")).where("first").select(key, "n"), "kept")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("tag")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = keyed.join(small(kept.where("n = 1").select(key), BROADCAST_ROWS), key, "left_semi")
    several = keyed.join(small(kept.where("n > 1").select(key), BROADCAST_ROWS), key, "left_semi")
    row = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return single.select(own).unionByName(several.withColumn(nth, row).where(F.col(nth) == 1).select(own))
