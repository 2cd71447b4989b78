"""Scores of whole alignments: sums over pairs of rows, and what columns give without pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.operators.columns import GAP_OPEN, pair_score
from genomill.operators.tallies import CLASSES, GAP, MOVES, tallied

LETTERS = "ACGT"
#: Share of a gap's opening that a row going on with a gap adds beside a row that opens one, where pairs aren't looked at.
BESIDE = 0.2

_AT = np.full(256, 4, np.int8)
_AT[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_TABLE = np.zeros((5, 5))
_TABLE[:4, :4] = [[pair_score(x, y) for y in LETTERS] for x in LETTERS]


def score_pair(a: str, b: str) -> tuple[float, float]:
    """Letters and gaps of two rows. Columns where both have a gap don't count.

    Between two columns of letters each row opens at most one gap, however often the gaps take turns. A gap that opens in the
    first column, and one that is open at the end, cost half.
    """
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    gap_x, gap_y = (np.isin(s, [45, 46]) for s in (x, y))
    letters = float(_TABLE[_AT[x], _AT[y]].sum())
    any_ = ~(gap_x & gap_y)
    gap_x, gap_y = gap_x[any_], gap_y[any_]
    if not len(gap_x):
        return letters, 0.0
    stretch = np.cumsum(~(gap_x | gap_y))
    opened = len(np.unique(stretch[gap_x])) + len(np.unique(stretch[gap_y]))
    half = int(gap_x[0] or gap_y[0]) + int(gap_x[-1] or gap_y[-1])
    return letters, GAP_OPEN * (opened - half / 2)


def scores_beside(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What `score_pair` gives, letters and gaps in one, of a row with each of several; all as code points."""
    x, y = (_AT[np.minimum(r, 255)] for r in (row, rows))
    gap_x, gap_y = (row == 45) | (row == 46), (rows == 45) | (rows == 46)
    score = _TABLE.ravel()[x * 5 + y].sum(axis=1)
    any_ = ~(gap_x & gap_y)
    some = any_.any(axis=1)
    if not some.any():
        return score
    both, here = ~(gap_x | gap_y), np.arange(len(rows))
    opened = -0.5 * sum((gap_x[at] | gap_y[here, at]) & some for at in (any_.argmax(axis=1), len(row) - 1 - any_[:, ::-1].argmax(axis=1)))
    for gap in (gap_x & ~gap_y, gap_y & ~gap_x):  # of what is this gap or letters in both rows, a gap behind letters opens
        seen = gap | both
        now, n = gap[seen], seen.sum(axis=1)
        ends = np.cumsum(n)
        begin = (ends - n)[n > 0]
        first = now.copy()
        first[1:] &= ~now[:-1]
        first[begin] = now[begin]
        total = np.append(0, np.cumsum(first))
        opened = opened + total[ends] - total[ends - n]
    return score + GAP_OPEN * opened


def pair_scores(rows: DataFrame, group: str = "set_id", between: Column | None = None) -> DataFrame:
    """group, a, b (b < a), letters, gaps of the pairs of a group's rows (group, seq_id, seq); `between`: a condition on a and b. One pair a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_pair(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (group, "a", "b")), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=[group, "a", "b", "letters", "gaps"])

    x, y = rows.select(group, F.col("seq_id").alias("a"), F.col("seq").alias("x")), rows.select(group, F.col("seq_id").alias("b"), F.col("seq").alias("y"))
    pairs = x.join(y, group).where(F.col("b") < F.col("a"))
    pairs = pairs.where(between) if between is not None else pairs
    return pairs.mapInArrow(run, f"{group} long, a long, b long, letters double, gaps double")


def summed_pairs(pairs: DataFrame, weights: DataFrame, group: str = "set_id") -> DataFrame:
    """group, letters, gaps, score: pair scores times the weights (group, seq_id, weight) of both rows."""
    w = lambda c: weights.select(group, F.col("seq_id").alias(c), F.col("weight").alias(f"w_{c}"))
    both = F.col("w_a") * F.col("w_b")
    total = pairs.join(w("a"), [group, "a"]).join(w("b"), [group, "b"]).groupBy(group).agg(F.sum(both * F.col("letters")).alias("letters"), F.sum(both * F.col("gaps")).alias("gaps"))
    return total.withColumn("score", F.col("letters") + F.col("gaps"))


_SCORE = _TABLE[:4, :4]
_L, _M = len(CLASSES), len(CLASSES) + len(MOVES)


def weighted(rows: DataFrame, weights: DataFrame, group: str = "set_id") -> DataFrame:
    """The rows (group, seq_id, seq) that have a weight, with it; a row is met once."""
    return rows.select(group, "seq_id", "seq").join(weights, [group, "seq_id"])


def shared_out(s: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted letters (f: ACGT x columns), gap transitions (ll, lg, gl, gg), gap penalties and each letter's score, as shares of a column's weight; `none`: no letters, `held`: some row is there."""
    total = s[:_L].sum(0)
    one = np.where(total > 0, total, 1.0)
    f = (s[:4] + s[4] / 20) / one
    move = dict(zip(MOVES, s[_L:_M] / one, strict=True))
    gaps = {"open": (1 - move["lg"]) * GAP_OPEN / 2, "close": (1 - move["le"]) * GAP_OPEN / 2}
    letters = s[[i for i in range(_L) if i != GAP]]
    return {"f": f, **move, **gaps, "score": _SCORE @ f, "none": ~(letters > 0).any(0), "held": total > 0}


def fast_sum_of_pairs(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """The sum over pairs of weighted rows from what each column holds of every letter and gap transition: work by columns, not by pairs.

    Gaps are judged by one column and the one before: one row opens a gap beside a row that doesn't, or, at a share, beside one in a gap.
    """

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        f, square, (ll, lg, gl, gg) = s[:4], s[_M : _M + 4], s[_L : _L + 4]
        letters = ((f[:, None] * f[None]).sum(2) * _SCORE).sum() / 2 - (square.sum(1) * _SCORE.diagonal()).sum() / 2
        gaps = (lg * (ll + gl + BESIDE * gg)).sum() * GAP_OPEN
        return {"letters": np.array([letters]), "gaps": np.array([gaps])} if s.shape[1] else {"letters": np.zeros(0), "gaps": np.zeros(0)}

    return tallied(rows, made, "letters double, gaps double", group, moves=True, weight=True).withColumn("score", F.col("letters") + F.col("gaps"))


def profile_sequence_score(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, score: every weighted row against the profile of the whole alignment, itself included, times its weight. Rows with one letter in a column score alike, so columns are enough."""

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        p = shared_out(s)
        score = (s[:4] * p["score"]).sum() + (s[_L + 1] * p["open"] + s[_L + 4] * p["close"]).sum()
        return {"score": np.array([score][: int(s.shape[1] > 0)])}

    return tallied(rows, made, "score double", group, moves=True, weight=True)


def between_profiles(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, col, match, gap: two alignments of the same columns as profiles, those of the weighted rows of even and of odd seq_id.

    match: joint score of two columns with letters. gap: a stretch without letters in one of them costs what opening and closing it
    costs in the other. both: letters in both columns; held_0, held_1: shares of letters. Columns of groups without both halves are left out.
    """

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        x, y = (shared_out(h) for h in s)
        at = np.flatnonzero(x["held"] & y["held"])
        cost = []
        for gapped, other in ((x, y), (y, x)):
            beside = np.concatenate([[False], gapped["none"] & gapped["held"], [False]])
            cost.append(np.where(~beside[2:], other["close"], 0.0) + np.where(~beside[:-2], other["open"], 0.0))
        a, b = x["none"], y["none"]
        match = np.where(a | b, 0.0, (x["f"] * y["score"]).sum(0))
        gap = np.where(a & b, 0.0, np.where(a, cost[0], np.where(b, cost[1], 0.0)))
        out = {"col": np.arange(s.shape[2], dtype=np.int32), "match": match, "gap": gap, "both": ~(a | b), "held_0": 1 - x["lg"] - x["gg"], "held_1": 1 - y["lg"] - y["gg"]}
        return {k: v[at] for k, v in out.items()}

    return tallied(rows, made, "col int, match double, gap double, both boolean, held_0 double, held_1 double", group, moves=True, weight=True, halves=True)


def column_scores(both: DataFrame, group: str = "set_id") -> DataFrame:
    """group, col, sp, ns, spn, le: the joint score of two columns, as it is and less a centre, and the weighted logarithm with the share of letters of both.

    le is -2.5 where nothing matches, and null where the joint score has no logarithm.
    """
    s = F.col("match")
    return both.where("both").select(
        group, "col", s.alias("sp"), (s - CENTRE["ns"]).alias("ns"), (s - CENTRE["spn"]).alias("spn"), F.when(s == 0, -2.5).when(s > 0, (F.log(s) - CENTRE["le"]) * F.col("held_0") * F.col("held_1")).alias("le")
    )


# Centres of the joint scores.
CENTRE = {"le": -0.52, "ns": 0.0, "spn": -300.0}
