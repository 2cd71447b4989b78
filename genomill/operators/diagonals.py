"""Diagonals: stretches that two sequences have in common, found from short windows, and the regions that an alignment keeps to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.operators.exact import Windows, codes_of

#: Symbols of a window, shortest diagonal, symbols at either end of a diagonal that are aligned anew, least length beyond a window.
K, SHORTEST, MARGIN, SLOP = 7, 24, 5, 16


def _run_ends(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Last symbol (in x) of the common stretch from each hit on; hits that follow each other on a diagonal share its end."""
    tail = np.append((np.diff(a) != 1) | (np.diff(b) != 1), True)[: len(a)]
    at, end = np.flatnonzero(tail), a + k - 1
    shift, open_ = b - a, at
    while len(open_):
        nxt = end[open_] + 1
        fits = (nxt < len(x)) & (nxt + shift[open_] < len(y))
        same = fits.copy()
        p, q = nxt[fits], (nxt + shift[open_])[fits]
        same[fits] = (x[p] == y[q]) & (x[p] < 4)
        open_ = open_[same]
        end[open_] += 1
    return end[at[np.searchsorted(at, np.arange(len(a)))]]


def find_diagonals(first: str | bytes, second: str | bytes, k: int = K, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start in first, start in second, length), in order of the shorter sequence.

    Each window of the longer sequence but the last stands for its last place there. The shorter one is read from the left:
    a window that the longer has is extended to the right as far as symbols agree, and reading goes on behind it, whether it is long
    enough to be kept or not. N is in no window and ends an extension. Sequences of fewer than k + 16 symbols have none.
    """
    x, y = codes_of(first), codes_of(second)
    if min(len(x), len(y)) < k + SLOP:
        return []
    swap = len(x) >= len(y)
    a, b = (y, x) if swap else (x, y)
    known, own = Windows(b[:-1], k), Windows(a[:-1], k)
    last = known.places[known.first + known.count - 1] if len(known.values) else known.places
    index = np.repeat(known.find(own.values), own.count)
    hit = index >= 0
    order = np.argsort(own.places[hit])
    at, to = own.places[hit][order], last[index[hit][order]]
    end = _run_ends(at, to, a, b, k)
    found, i = [], 0
    while i < len(at):
        n = int(end[i] - at[i]) + 1
        if n >= shortest:
            found.append((int(to[i]), int(at[i]), n) if swap else (int(at[i]), int(to[i]), n))
        i = int(np.searchsorted(at, end[i] + 1))
    return found


_KIND = pa.schema([("ref_id", pa.int64()), ("query_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("len", pa.int64())])


def diagonals(pairs: DataFrame, k: int = K, shortest: int = SHORTEST) -> DataFrame:
    """ref_id, query_id, i, a, b, len of each pair (ref_id, ref_seq, query_id, seq), a row of its own; i from 0 in order of a, then b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref_id, ref, query_id, seq in zip(*(batch.column(c) for c in ("ref_id", "ref_seq", "query_id", "seq")), strict=True):
                rows += [(ref_id.as_py(), query_id.as_py(), *d) for d in find_diagonals(ref.as_py(), seq.as_py(), k, shortest)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KIND.types)], schema=_KIND)

    found = pairs.select("ref_id", "ref_seq", "query_id", "seq").mapInArrow(run, "ref_id long, query_id long, a long, b long, len long")
    rank = F.row_number().over(Window.partitionBy("ref_id", "query_id").orderBy("a", "b")) - 1
    return found.select("ref_id", "query_id", rank.cast("long").alias("i"), "a", "b", "len")


def regions(kept: DataFrame, sizes: DataFrame, group: str, margin: int = MARGIN) -> DataFrame:
    """group, nth, kind, a, a_len, b, b_len: what an alignment of a pair consists of, in order.

    The inner part of each diagonal, without `margin` symbols at either end, is taken as it is (kind diag); the rectangles before,
    between and behind them are to be aligned (kind rect). sizes: group, a_size, b_size of every pair; a pair without
    diagonals is one rectangle.
    """
    w = Window.partitionBy(group).orderBy("a", "b")
    spans = kept.select(group, F.row_number().over(w).alias("n"), (F.col("a") + margin).alias("a0"), (F.col("b") + margin).alias("b0"), (F.col("a") + F.col("len") - margin).alias("a1"), (F.col("b") + F.col("len") - margin).alias("b1"))
    ends = sizes.join(spans.groupBy(group).agg(F.max("n").alias("n")), group, "left").select(group, (F.coalesce("n", F.lit(0)) + 1).alias("n"), F.col("a_size").alias("a0"), F.col("b_size").alias("b0"), F.lit(None).cast("long").alias("a1"), F.lit(None).cast("long").alias("b1"))
    v = Window.partitionBy(group).orderBy("n")
    each = spans.unionByName(ends).withColumns({"pa": F.coalesce(F.lag("a1").over(v), F.lit(0)), "pb": F.coalesce(F.lag("b1").over(v), F.lit(0))})
    part = lambda nth, kind, a, b, to_a, to_b: F.struct((2 * F.col("n") - nth).alias("nth"), F.lit(kind).alias("kind"), F.col(a).alias("a"), (F.col(to_a) - F.col(a)).alias("a_len"), F.col(b).alias("b"), (F.col(to_b) - F.col(b)).alias("b_len"))
    both = F.when(F.col("a1").isNull(), F.array(part(2, "rect", "pa", "pb", "a0", "b0"))).when(F.col("a1") <= F.col("a0"), F.array(part(2, "rect", "pa", "pb", "a0", "b0"))).otherwise(F.array(part(2, "rect", "pa", "pb", "a0", "b0"), part(1, "diag", "a0", "b0", "a1", "b1")))
    return each.select(group, F.inline(both))
