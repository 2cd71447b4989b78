"""Nearest vectors by inner product: stable projections in kd-trees, verified until a chi-square test stops the search.

Largest inner product becomes least distance: vectors are divided by the greatest length among them and get one more
component that makes all of them one long; a query is made one long too. Gaussian, that is 2-stable, projections to
`DIMENSIONS` numbers keep distances in this sense: the squared distance of two projections is the squared distance of the
vectors times a chi-square variable of as many degrees of freedom. The projections of a block are indexed by a kd-tree. A
query opens its leaves nearest first and verifies their rows with true inner products. With d the distance of its k-th best
so far it stops at the first leaf whose box lies beyond d * sqrt(t), t being the quantile `CONFIDENCE` of that chi-square
law: a nearer vector would by then have been seen with this probability. Queries of a task open leaves together, so that
products are made as matrices in single precision; what these can't tell from the k-th best is computed in double precision.
Of equal vectors a block keeps the few rows of smallest vec_id that a query could return.

Rows are dealt to cells of a coarse kd-tree, whose split values come from a bounded sample of projections (`SAMPLE` rows;
all rows are indexed), and a cell of many rows to blocks, so equal vectors in any number don't meet in one task. A query
first searches one block of its own cell. With what it has found it then goes to all other blocks whose cell's box the test
doesn't exclude; it travels once to each of `GROUPS` groups of blocks. A block is shipped once for `ASKED` queries. Blocks
grow with the table up to `ROWS` rows, so the visits of a query don't; where vectors have no structure that 12
projections show, the test opens most leaves, and the products alone grow as rows times queries.

Defined cases: vectors null, empty, zero or with null or non-finite components and rows without vec_id take no part;
shorter vectors count as filled up with zeros; candidates are the rows of another vec_id than the query's; of repeated rows
each is a candidate and one a query, while different vectors of one vec_id are queries of their own; ties go to the smaller
vec_id; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm.common import release, small, stash, union

DIMENSIONS = 12
CONFIDENCE = 0.97
SEED = 12
#: Most rows of a block, most queries that one copy of a block serves, points of a leaf; most components of either in a task.
ROWS, ASKED, LEAF, VALUES = 65_536, 65_536, 64, 1 << 22
#: A block has `FEW` rows until there are `BLOCKS` blocks. Groups of blocks that queries travel to.
FEW, BLOCKS, GROUPS = 8_192, 64, 12
#: Queries that open leaves together, products made at once, candidates that are gathered, and verified at once.
SLAB, TILE, CHECKED, CACHED = 1_024, 1 << 19, 1 << 16, 1 << 11
#: Most rows whose projections make the split values of the coarse tree, and its most cells.
SAMPLE, CELLS = 20_000, 4_096
#: Most rows of a table with one row a block that is broadcast.
BROADCAST_BLOCKS = 500_000


def chi_square(x: float, m: int) -> float:
    """P(X <= x) for an even number m of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, m: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


class Space:
    """How vectors are scaled, lengthened and projected. `largest`: greatest absolute component; `longest`: greatest length of a vector divided by it."""

    def __init__(self, width: int, largest: float, longest: float):
        self.width, self.largest, self.longest = width, largest, longest
        self.matrix = np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))

    def matrix_of(self, column: pa.Array) -> np.ndarray:
        """The vectors as rows, filled up with zeros."""
        flat, at = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
        sizes = np.diff(at)
        out = np.zeros((len(sizes), self.width))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = flat
        return out

    def reach(self, q: np.ndarray, score: np.ndarray, stop: float) -> np.ndarray:
        """Squared projected distances from which on the test stops a search with query q, if its k-th best product is `score`."""
        length = np.sqrt(np.einsum("...i,...i->...", q / self.largest, q / self.largest)) * self.longest
        with np.errstate(over="ignore", invalid="ignore"):
            far = 2 - 2 * (score / self.largest / self.largest) / length
        return np.where(np.isfinite(far), stop * np.maximum(0.0, far) + 1e-9, np.inf)

    def projected(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Equal rows have equal projections wherever they stand, which a product of matrices doesn't promise."""
        x = x / self.largest / self.longest
        own = np.einsum("ij,ij->i", x, x)
        if query:
            x, last = x / np.sqrt(own)[:, None], np.zeros(len(x))
        else:
            last = np.sqrt(np.maximum(0.0, 1 - own))
        return np.einsum("ij,jk->ik", x, self.matrix[:-1]) + last[:, None] * self.matrix[-1]


class Coarse:
    """A kd-tree of few levels: split axis and value of its inner nodes in heap order; its leaves are the cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [points]
        for level in range(depth):
            below = []
            for i, p in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(p):
                    self.axis[node] = int(np.ptp(p, axis=0).argmax())
                    self.value[node] = np.median(p[:, self.axis[node]])
                right = p[:, self.axis[node]] > self.value[node]
                below += [p[~right], p[right]]
            parts = below

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - len(self.axis)


def true_at(mask: np.ndarray) -> np.ndarray:
    """Places of the few true values of a mask, looked for eight at a time."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view(np.uint64))
    i, j = np.nonzero(flat[:whole].reshape(-1, 8)[eight])
    return np.concatenate([eight[i] * 8 + j, whole + np.flatnonzero(flat[whole:])])


def outside(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of points from boxes."""
    out, low, high = np.zeros((len(at), len(low))), np.asfortranarray(low), np.asfortranarray(high)
    for i in range(0, len(at), step := max(1, CACHED * 8 // len(low))):
        part, away = out[i : i + step], np.empty_like(out[i : i + step])
        for d in range(DIMENSIONS):
            own = at[i : i + step, d, None]
            np.minimum(np.maximum(own, low[:, d], out=away), high[:, d], out=away)
            away -= own
            away *= away
            part += away
    return out


class Asked:
    """Queries that search together, with the k best of each so far; `least`: the k-th best product that is known from elsewhere."""

    def __init__(self, space: Space, k: int, ids: np.ndarray, x: np.ndarray, least: np.ndarray, home: np.ndarray):
        self.space, self.k, self.ids, self.x, self.least, self.home = space, k, ids, x, least, home
        self.at = space.projected(x, query=True)
        self.peak = np.abs(x).max(axis=1)
        scaled = x / self.peak[:, None]
        self.short = scaled.astype(np.float32)
        #: Above the error of a product in single precision, and of one in double precision that underflows.
        with np.errstate(over="ignore"):
            self.slack = (space.width + 4) * 2.0**-22 * np.sqrt(np.einsum("ij,ij->i", scaled, scaled)) * space.longest + space.width * 5e-324 / space.largest / self.peak
        self.query, self.found, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def bar(self) -> np.ndarray:
        """The k-th best product of every query, -inf if not known."""
        bar, n = self.least.copy(), np.bincount(self.query, minlength=len(self.ids))
        full = np.flatnonzero(n == self.k)
        bar[full] = np.fmax(bar[full], self.score[np.cumsum(n)[full] - 1])
        return np.where(np.isfinite(bar), bar, -np.inf)

    def least_short(self) -> np.ndarray:
        """The least product in single precision that may reach the bar."""
        with np.errstate(over="ignore"):
            return (self.bar() / self.space.largest / self.peak - self.slack).astype(np.float32)[:, None]

    def add(self, query: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Query by query one of the rows of ids and x."""
        score = np.empty(len(query))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(0, len(query), CACHED):
                score[i : i + CACHED] = np.einsum("ij,ij->i", x[rows[i : i + CACHED]], self.x[query[i : i + CACHED]])
        fit = ~(score < self.bar()[query])
        q, own, score = np.append(self.query, query[fit]), np.append(self.found, ids[rows[fit]]), np.append(self.score, score[fit])
        order = np.lexsort((own, -score, q))
        q, own, score = q[order], own[order], score[order]
        n = np.bincount(q, minlength=len(self.ids))
        keep = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) < self.k
        self.query, self.found, self.score = q[keep], own[keep], score[keep]

    def lists(self) -> tuple[pa.Array, pa.Array]:
        """vec_ids and inner products of every query's k best, best first."""
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(self.query, minlength=len(self.ids)))), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(self.found, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(self.score, pa.float64()))


class Block:
    """The vectors of a block with a kd-tree over their projections, cut to leaves of at most `LEAF` points."""

    def __init__(self, space: Space, number: int, ids: np.ndarray, x: np.ndarray, k: int):
        points = space.projected(x)
        fit = self.wanted(ids, x, points[:, 0], k)
        ids, x, points = ids[fit], x[fit], points[fit]
        order, edges = np.arange(len(ids)), [0, len(ids)]
        while max(np.diff(edges), default=0) > LEAF:
            cut = [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > LEAF:
                    own = order[a:b]
                    along = points[own, np.ptp(points[own], axis=0).argmax()]
                    order[a:b] = own[np.argpartition(along, (b - a) // 2)]
                    cut.append(a + (b - a) // 2)
                cut.append(b)
            edges = cut
        self.space, self.number, self.edges = space, number, np.array(edges)
        self.ids, self.x, points = ids[order], x[order], points[order]
        self.short = (self.x / space.largest).astype(np.float32)
        self.leaf = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.low, self.high = np.minimum.reduceat(points, self.edges[:-1]), np.maximum.reduceat(points, self.edges[:-1])

    @staticmethod
    def wanted(ids: np.ndarray, x: np.ndarray, along: np.ndarray, k: int) -> np.ndarray:
        """Rows that a query could return: of equal vectors k of one id at most, and of those the first 2 k by id, k of them of other ids than the query's."""

        def ranks(same: np.ndarray) -> np.ndarray:
            at = np.arange(len(same) + 1)
            return at - np.maximum.accumulate(np.where(np.append(False, same), 0, at))

        order = np.lexsort((ids, along))
        equal = np.zeros(max(0, len(order) - 1), bool)
        near = np.flatnonzero(along[order[1:]] == along[order[:-1]])
        for i in range(0, len(near), CHECKED):
            some = near[i : i + CHECKED]
            equal[some] = (x[order[some]] == x[order[some + 1]]).all(axis=1)
        once = ranks(equal & (ids[order[1:]] == ids[order[:-1]])) < k
        run = np.cumsum(np.append(True, ~equal))[once]
        return order[once][ranks(run[1:] == run[:-1]) < 2 * k]

    def search(self, asked: Asked, stop: float) -> None:
        """Adds to what the queries have found, but for those whose home this block is."""
        limit = self.space.reach(asked.x, asked.bar(), stop)
        who = np.flatnonzero((asked.home != self.number) & (outside(self.low.min(axis=0)[None], self.high.max(axis=0)[None], asked.at)[:, 0] <= limit))
        boxes = outside(self.low, self.high, asked.at[who])
        closed = np.ones(boxes.shape, bool)  # not opened yet
        many, done = max(2, 2 * asked.k // LEAF), 0
        new = np.flatnonzero(limit[who] == np.inf)
        order = np.argsort(boxes[new], axis=1, kind="stable") if len(new) else None
        for upto in (many, 8 * many) if len(new) else ():
            open_ = np.zeros(boxes.shape, bool)
            open_[new[:, None], order[:, done:upto]] = True
            self._verify(asked, who, open_ & (boxes <= limit[who, None]))
            closed &= ~open_
            limit, done = self.space.reach(asked.x, asked.bar(), stop), upto
        self._verify(asked, who, closed & (boxes <= limit[who, None]))

    def _verify(self, asked: Asked, who: np.ndarray, open_: np.ndarray) -> None:
        """Rows of the leaves that the queries `who` open. Leaves that many open are held against all, others against their own."""
        active = np.flatnonzero(open_.any(axis=1))
        n, least, found, waiting = open_.sum(axis=0), asked.least_short(), [], 0

        def flush() -> None:
            nonlocal found, waiting
            if found:
                own, rows = (np.concatenate(v) for v in zip(*found, strict=True))
                asked.add(who[own], rows, self.ids, self.x)
            found, waiting = [], 0

        def held(own: np.ndarray, rows: np.ndarray | slice, at: np.ndarray) -> None:
            nonlocal waiting
            q = who[own]
            hit = true_at(asked.short[q] @ self.short[rows].T >= least[q])
            i, j = np.divmod(hit, len(at))
            i, j = own[i], at[j]
            fit = open_[i, self.leaf[j]] & (asked.ids[who[i]] != self.ids[j])
            i, j = i[fit], j[fit]
            for a in range(0, len(i), CHECKED):
                found.append((i[a : a + CHECKED], j[a : a + CHECKED]))
                waiting += len(found[-1][0])
                if waiting >= CHECKED:
                    flush()

        common = 4 * n >= max(1, len(active))
        rows = np.flatnonzero(common[self.leaf])
        step = max(LEAF, TILE // max(1, len(active)))
        for a in range(0, len(rows), step):
            at = rows[a : a + step]
            held(active, slice(at[0], at[-1] + 1) if at[-1] - at[0] + 1 == len(at) else at, at)
        for leaf in np.flatnonzero((n > 0) & ~common):
            a, b = self.edges[leaf], self.edges[leaf + 1]
            held(np.flatnonzero(open_[:, leaf]), slice(a, b), np.arange(a, b))
        flush()


def _measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, most components, greatest absolute component and the logarithm of the greatest length of a task's batches."""
    n, width, largest, length = 0, 0, 0.0, -math.inf
    for batch in batches:
        column = batch.column("x")
        if not len(column):
            continue
        flat, at = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
        at = at - at[0]
        peak = np.maximum.reduceat(np.abs(flat), at[:-1])
        own = flat / np.repeat(peak, np.diff(at))
        n, width, largest = n + len(column), max(width, int(np.diff(at).max())), max(largest, float(peak.max()))
        length = max(length, float((np.log(peak) + np.log(np.add.reduceat(own * own, at[:-1])) / 2).max()))
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([width], pa.int32()), pa.array([largest]), pa.array([length])], names=["n", "width", "largest", "length"])


def _projecting(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(space.projected(space.matrix_of(batch.column("x")))), pa.list_(pa.float64()))], names=["point"])

    return run


def _dealing(space: Space, coarse: Coarse, first: np.ndarray, parts: np.ndarray):
    """Block of every row: its cell's first one and, by a hash of its id, one of the cell's others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            cell = coarse.cell(space.projected(space.matrix_of(batch.column("x"))))
            yield pa.RecordBatch.from_arrays([pa.array(first[cell] + np.asarray(batch.column("salt")) % parts[cell]), batch.column("id"), batch.column("x")], names=["block", "id", "x"])

    return run


def _boxing(space: Space, coarse: Coarse):
    """Rows and box of every cell in a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n, low, high = np.zeros(1 << coarse.depth, np.int64), np.full((1 << coarse.depth, DIMENSIONS), np.inf), np.full((1 << coarse.depth, DIMENSIONS), -np.inf)
        for batch in batches:
            points = space.projected(space.matrix_of(batch.column("x")))
            cell = coarse.cell(points)
            n += np.bincount(cell, minlength=len(n))
            np.minimum.at(low, cell, points)
            np.maximum.at(high, cell, points)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell]), pa.array(list(low[cell]), pa.list_(pa.float64())), pa.array(list(high[cell]), pa.list_(pa.float64()))], names=["cell", "n", "low", "high"])

    return run


def _searching(space: Space, k: int, kind: str):
    """Rows in order: the queries of a unit, then its blocks' vectors; the queries and one block are kept in memory."""
    stop, x_type = quantile(CONFIDENCE, DIMENSIONS), pa.list_(pa.float32() if kind == "float" else pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unit, number, asks, slabs, gathered = None, None, [], [], []

        def gather() -> None:
            """What has been gathered is searched, once it is whole."""
            nonlocal asks, gathered
            if asks:
                own = pa.Table.from_batches(asks).combine_chunks()
                slabs.extend(
                    (part, Asked(space, k, np.asarray(part.column("id")), space.matrix_of(part.column("x")), np.asarray(part.column("least")), np.asarray(part.column("home"))))
                    for i in range(0, len(own), SLAB) for part in own.slice(i, SLAB).combine_chunks().to_batches()
                )
            if gathered and slabs:
                block = Block(space, number, np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]), k)
                for _, asked in slabs:
                    block.search(asked, stop)
            asks, gathered = [], []

        def ended() -> Iterator[pa.RecordBatch]:
            gather()
            for part, asked in slabs:
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("of"), part.column("group"), part.column("x").cast(x_type), *asked.lists()], names=["query_id", "of", "block", "x", "ids", "scores"])
            slabs.clear()

        for batch in batches:
            keys = [np.asarray(batch.column(c)) for c in ("group", "chunk", "block")]
            edges = np.flatnonzero(np.any([np.diff(v) != 0 for v in keys], axis=0)) + 1
            for i, j in zip([0, *edges], [*edges, len(batch)], strict=True):
                if i == j:
                    continue
                group, chunk, block = (v[i] for v in keys)
                if unit != (group, chunk):
                    yield from ended()
                elif number != block:
                    gather()
                unit, number, part = (group, chunk), block, batch.slice(i, j - i)
                if block < 0:
                    asks.append(part)
                else:
                    gathered.append((np.asarray(part.column("id")), space.matrix_of(part.column("x"))))
        yield from ended()

    return run


def searched(dealt: DataFrame, visits: DataFrame, asked: DataFrame, space: Space, k: int, groups: int) -> DataFrame:
    """What every visit (group, id, of, x, least, home) finds in the blocks of its group, but its home; asked: group, n, the visits counted before."""
    spark, kind = dealt.sparkSession, dict(dealt.dtypes)["x"]
    salts = stash(asked.groupBy("group").agg(F.ceil(F.sum("n") / min(ASKED, max(1, VALUES // space.width))).alias("salts")), "salts")
    units, most = (v or 1 for v in salts.agg(F.sum("salts"), F.max("salts")).first())
    tasks = int(min(groups * most, max(16 * spark.sparkContext.defaultParallelism, units // 16)))
    salts = small(salts, BROADCAST_BLOCKS)
    none = F.lit(0).cast("long")
    copies = dealt.withColumn("group", F.pmod("block", F.lit(groups).cast("long"))).join(salts, "group").select("group", F.explode(F.sequence(none, F.col("salts") - 1)).alias("chunk"), "block", "id", none.alias("of"), "x", F.lit(0.0).alias("least"), none.alias("home"))
    asks = visits.join(salts, "group").select("group", F.pmod(F.xxhash64("id", "of"), "salts").alias("chunk"), F.lit(-1).cast("long").alias("block"), "id", "of", "x", "least", "home")
    return copies.unionByName(asks).repartitionById(tasks, F.expr(f"cast(pmod(group * {most} + chunk, {tasks}) as int)")).sortWithinPartitions("group", "chunk", "block", "id", "of").mapInArrow(_searching(space, k, kind[6:-1]), f"query_id long, of long, block long, x {kind}, ids array<long>, scores array<double>")


def _going(space: Space, cells: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, parts: np.ndarray, k: int, groups: int, count: bool):
    """The groups of blocks that a query, with what it has found in its own block, still has to search; `count`: only how many queries go to each."""
    stop, held = quantile(CONFIDENCE, DIMENSIONS), np.zeros((len(cells), groups))  # a cell's blocks in each group
    of = np.repeat(np.arange(len(cells)), parts[cells])
    np.add.at(held, (of, np.arange(len(of)) % groups), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not len(batch):
                continue
            x, home = space.matrix_of(batch.column("x")), np.asarray(batch.column("block"))
            scores, ends = np.asarray(batch.column("scores").flatten()), np.asarray(batch.column("scores").offsets)
            least, full = np.full(len(batch), -np.inf), np.flatnonzero(np.diff(ends) == k)
            least[full] = scores[ends[full + 1] - ends[0] - 1]
            reach, at, rows, to = space.reach(x, least, stop), space.projected(x, query=True), [], []
            for a in range(0, len(batch), CACHED // 8):
                own = slice(a, a + CACHED // 8)
                open_ = outside(low, high, at[own]) <= reach[own, None]
                n, i = open_ @ held, np.arange(len(open_))
                n[i, home[own] % groups] -= open_[i, np.searchsorted(first[cells], home[own], "right") - 1]
                i, group = np.nonzero(n > 0)
                rows.append(i + a)
                to.append(group.astype(np.int64))
            rows, to = np.concatenate(rows), np.concatenate(to)
            if count:
                group, n = np.unique(to, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(n, pa.int64())], names=["group", "n"])
                continue
            for a in range(0, len(rows), 10_000):
                part = batch.take(pa.array(rows[a : a + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 10_000], pa.int64()), part.column("query_id"), part.column("of"), part.column("x"), pa.array(least[rows[a : a + 10_000]]), part.column("block")], names=["group", "id", "of", "x", "least", "home"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """id, x: the rows that take part; single precision stays, as it takes half the place."""
    x = F.col("embedding").cast("array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>")
    # a null is not known to be less, and NaN is greater
    fine = F.forall(x, lambda v: F.abs(v) < float("inf")) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & fine)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k rows found of largest inner product."""
    spark, rows = vectors.sparkSession, stash(usable(vectors), "vectors")
    n, width, largest, longest = rows.select("x").mapInArrow(_measuring, "n long, width int, largest double, length double").agg(F.sum("n"), F.max("width"), F.max("largest"), F.max("length")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    space = Space(width, largest, math.exp(longest - math.log(largest)))
    most = min(ROWS, max(FEW, n // BLOCKS), max(1, VALUES // width))
    depth = min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(n / most))))
    share = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(math.ceil(2 * n / SAMPLE))) == 0).limit(SAMPLE)
    points = np.array(share.mapInArrow(_projecting(space), "point array<double>").toArrow().column("point").to_pylist() if depth else []).reshape(-1, DIMENSIONS)
    coarse = Coarse(points, depth)
    boxes = rows.mapInArrow(_boxing(space, coarse), "cell long, n long, low array<double>, high array<double>")
    edge = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(DIMENSIONS))).alias(c)
    found = boxes.groupBy("cell").agg(F.sum("n").alias("n"), edge(F.min, "low"), edge(F.max, "high")).orderBy("cell").collect()  # at most CELLS rows
    parts = np.zeros(1 << depth, np.int64)
    parts[[r.cell for r in found]] = [-(-r.n // most) for r in found]
    first = np.cumsum(parts) - parts
    cells, low, high = np.array([r.cell for r in found]), np.array([r.low for r in found]), np.array([r.high for r in found])

    kind = dict(rows.dtypes)["x"]
    deal = lambda df: df.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("salt")).mapInArrow(_dealing(space, coarse, first, np.maximum(parts, 1)), f"block long, id long, x {kind}")
    dealt, blocks = deal(rows), int(parts.sum())
    own = stash(deal(rows.where(F.col("id") % every == 0)).dropDuplicates(["id", "x"]), "queries")
    own = own.select(F.col("block").alias("group"), "id", F.xxhash64("x").alias("of"), "x", F.lit(float("-inf")).alias("least"), F.lit(-1).cast("long").alias("home"))
    home = stash(searched(dealt, own, own.groupBy("group").agg(F.count("*").alias("n")), space, k, blocks), "home")
    groups = min(blocks, GROUPS)
    going = lambda count: _going(space, cells, low, high, first, parts, k, groups, count)
    asked = home.mapInArrow(going(True), "group long, n long")
    visits = home.mapInArrow(going(False), f"group long, id long, of long, x {kind}, least double, home long")
    away = searched(dealt, visits, asked, space, k, groups)
    pairs = union([f.select("query_id", "of", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", "of", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score")) for f in (home, away)])
    best = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
