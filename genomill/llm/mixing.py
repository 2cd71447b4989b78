"""Mixing sources to target weights by the cube method.

Every source gets a target in words; each of its documents is then expected target / source size times. Whole copies are
taken outright and the fraction left is an inclusion probability. The flight phase moves these probabilities through the
null space of the two balancing equations (number of documents, number of words): three documents at a time, one reaches
0 or 1 at each step. Blocks of a large source fly independently, each keeping its own totals, until two documents a block are
left, often long ones; with them `HELD` documents of each block that sat out fly in the next round, in ever fewer blocks.
The landing phase rounds the last two documents of a source so that its words come nearest to the target. What they miss
is made up by documents of the last round whose draw is turned over, one or two at a time, while that brings the words
nearer; a source of few documents that still misses its target gets the best of all choices.

Defined cases: null text has no words; a null source is a source of its own and comes last; a source without words has
target 0 and takes nothing; repeated rows are documents of their own; an empty table gives no rows; the draw depends on
doc_id, size and seed only, so reruns agree. Columns beside doc_id, source and text are carried by `mixed` and not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm.common import release, small, stash, union, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
BLOCK, HELD = 2_000, 20
#: A source's last round searches all choices of up to EXACT open documents where turning draws misses by more than NEAR of their words.
EXACT, NEAR = 30, 0.002
SEED = 20
#: Most sources whose one-row totals are broadcast.
SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_docs, source_size, target: one row a source, so the windows hold sources, not documents.

    Resharing what exceeds a limit ends where every open source gets the same rate per weight. With sources by falling
    limit / weight, those before the cut are open; the cut is the first place where the common rate fits below its limit.
    """
    totals = sized.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    low = Window.partitionBy(F.lit(0)).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(F.lit(0)).orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    rates = caps.withColumn("rate", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(low), F.lit(0.0))) / F.sum("weight").over(high))
    rate = F.coalesce(F.max(F.when(F.col("rate") <= F.col("level"), F.col("rate"))).over(every), F.max("level").over(every))
    return rates.withColumn("rate", rate).select("source", "source_docs", "source_size", F.least("cap", F.col("rate") * F.col("weight")).alias("target"))


def fly(p: np.ndarray, x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight over documents in the given order: the equations sum(p) and sum(p * x) hold; at most two stay between 0 and 1."""
    p, x, draw = p.tolist(), x.tolist(), draw.tolist()
    live: list[int] = []
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not any(u):
                u = (1.0, -1.0, 0.0)
            _move(p, live, u, draw[k])
            live = [i for i in live if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(p: np.ndarray, x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The last two documents: of the ways to round them, the one that misses the words least, then the documents; ties by draw."""
    p = p.copy()
    live = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]

    def cost(way: tuple) -> tuple:
        return round(abs(sum(x[i] * (q - p[i]) for i, q in zip(live, way, strict=True))), 6), round(abs(sum(q - p[i] for i, q in zip(live, way, strict=True))), 6), (draw[live[0]] < 0.5) == bool(way[0])

    if live:
        p[live] = min(product((0.0, 1.0), repeat=len(live)), key=cost)
    return p


def repair(p: np.ndarray, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Turns over draws of documents that were open at the start, one or two at a time, each time those that leave the words nearest to the target.

    Where that still misses by more than `NEAR` of the words that the open documents should give, and there are at most
    `EXACT` of them, the best of all their choices is taken.
    """
    p, open_ = p.copy(), np.flatnonzero((start > 0) & (start < 1) & (x > 0))
    if not len(open_):
        return p
    miss = float((x * (p - start)).sum())
    while abs(miss) > 1e-6:
        change = np.where(p[open_] > 0.5, -x[open_], x[open_])
        turned = _nearest_turn(change, miss)
        after = miss + float(change[turned].sum())
        if not abs(after) < abs(miss) - 1e-6:
            break
        p[open_[turned]], miss = 1 - p[open_[turned]], after
    if len(open_) <= EXACT and abs(miss) > NEAR * float((x * start)[open_].sum()):
        best = _best_choice(x[open_], float((x[open_] * p[open_]).sum()) - miss)
        if abs(float((x[open_] * (best - p[open_])).sum()) + miss) < abs(miss) - 1e-6:
            p[open_] = best
    return p


def _nearest_turn(change: np.ndarray, miss: float) -> list[int]:
    """The one change, else the two, whose sum comes nearest to -miss; pairs are met in sorted order, never listed."""
    single = int(np.abs(change + miss).argmin())
    order = np.argsort(change, kind="stable")
    sums, place = change[order], np.arange(len(change))
    found = [(abs(change[single] + miss), [single])]
    for shift in (-2, -1, 0, 1):  # the neighbours of the wanted partner, whichever of them is the document itself
        other = np.clip(np.searchsorted(sums, -miss - sums) + shift, 0, len(sums) - 1)
        left = np.where(other == place, np.inf, np.abs(sums + sums[other] + miss))
        k = int(left.argmin())
        if np.isfinite(left[k]):
            found.append((left[k], [int(order[k]), int(order[other[k]])]))
    return min(found, key=lambda f: f[0])[1]


def _best_choice(x: np.ndarray, wanted: float) -> np.ndarray:
    """0 or 1 for each document so that the words come nearest to those wanted: the sums of two halves meet in sorted order."""
    half = len(x) // 2
    sums = []
    for part in (x[:half], x[half:]):
        total = np.zeros(1)
        for size in part:
            total = np.concatenate((total, total + size))  # bit j of the place: whether document j is in
        sums.append(total)
    order = np.argsort(sums[1], kind="stable")
    right = sums[1][order]
    near = np.searchsorted(right, wanted - sums[0])
    best = min(((np.abs(sums[0] + right[at] - wanted), at) for at in (np.clip(near - 1, 0, len(right) - 1), np.clip(near, 0, len(right) - 1))), key=lambda f: f[0].min())
    one = int(best[0].argmin())
    two = int(order[best[1][one]])
    return np.array([one >> j & 1 for j in range(half)] + [two >> j & 1 for j in range(len(x) - half)], float)


def _move(p: list, live: list, u: tuple, draw: float) -> None:
    up, down = float("inf"), float("inf")
    for i, d in zip(live, u, strict=True):
        if d > 0:
            up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
        elif d < 0:
            up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
    step = up if draw < down / (up + down) else -down
    for i, d in zip(live, u, strict=True):
        q = p[i] + step * d
        p[i] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q


def _draws(ids: pd.Series, turn: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{turn}:{i}", SEED) / 2.0**64 for i in ids])


def _flight(turn: int, final: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        release()
        draw = _draws(block["doc_id"], turn)
        at = np.lexsort((draw, -block["size"].to_numpy()))  # the longest first: those left are short
        block, draw = block.iloc[at], draw[at]
        p, x = block["p"].to_numpy(float, copy=True), block["size"].to_numpy(float)
        if final:
            return block.assign(p=repair(land(fly(p, x, draw), x, draw), p, x))[["doc_id", "source", "size", "p"]]
        live, flies = np.flatnonzero((p > 0) & (p < 1)), np.ones(len(p), bool)
        flies[live[np.linspace(len(live) // 10, len(live) - 1, min(HELD, len(live))).astype(int)]] = False
        p[flies] = fly(p[flies], x[flies], draw[flies])
        return block.assign(p=p)[["doc_id", "source", "size", "p"]]

    return run


def cube_sample(units: DataFrame) -> DataFrame:
    """doc_id, source, size, p in [0, 1] -> the same rows with p 0 or 1, balanced within each source."""
    left = units.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "p")
    schema = left.schema
    done, turn = [], 0
    while True:
        counts = left.where("p > 0 and p < 1").groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        final = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        block = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + turn)), F.coalesce("blocks", F.lit(1)))
        salted = left.join(small(counts, SOURCES), F.col("source").eqNullSafe(F.col("of")), "left").select(*left.columns, block.alias("block"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
        flying = salted if final else salted.where("blocks > 1")  # a source of one block waits for the last round
        flown = flying.groupBy("source", "block").applyInPandas(_flight(turn, final), schema)
        flown = stash(flown if final else flown.unionByName(salted.where("blocks = 1").select(left.columns)), "cube")
        if final:
            return union([*done, flown]).withColumn("doc_id", F.col("doc_id").cast("long"))
        done.append(flown.where("p = 0 or p = 1"))
        left, turn = flown.where("p > 0 and p < 1"), turn + 1


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    sized = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size")), "sized")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(limit))).otherwise(0.0)
    targets = stash(source_targets(sized, weights, share, limit).withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9)), "targets").withColumnRenamed("source", "of")
    part = F.col("rate") - F.col("whole")
    same = F.col("source").eqNullSafe(F.col("of"))
    flown = cube_sample(sized.join(small(targets, SOURCES), same).select("doc_id", "source", "size", F.when(part > 1e-9, part).otherwise(0.0).alias("p")))
    return flown.join(small(targets, SOURCES), same).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with all its columns."""
    key, copies, rows, each = (unused(docs) + name for name in ("key", "copies", "rows", "each"))
    unit = F.struct(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"))
    units = mix(docs).groupBy(F.struct("doc_id", "source", "size").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    joined = docs.withColumn(key, unit).join(units, key)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    taken = F.floor(F.col(copies) / F.col(rows)) + (nth <= F.col(copies) % F.col(rows)).cast("int")
    return joined.withColumn(each, taken.cast("int")).where(F.col(each) > 0).withColumn(each, F.explode(F.array_repeat(F.lit(1), F.col(each)))).select(*(F.col(f"`{c}`") for c in docs.columns))
