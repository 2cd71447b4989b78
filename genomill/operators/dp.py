"""Alignment kernels on numpy: profile against profile, local alignment, partial-order alignment.

These run inside Arrow functions, one small group at a time.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator, Sequence

import numpy as np

from genomill.operators.columns import GAP_OPEN, pair_score

LETTERS = "ACGT"
SCORES = np.array([[pair_score(a, b) for b in LETTERS] for a in LETTERS], float)
GAP, LOW = ord("-"), -1e18
#: Columns of sides that are not told apart; length of the vectors at most, and cells computed together (4 bytes each are held); letters of works that go on side by side.
SMALL, WIDE, CELLS, BESIDE = 32, 1 << 15, 1 << 25, 1 << 23
#: Where fewer pairs of a class are asked for, those of the next smaller classes go with them.
FEW = 8
#: Cells that cost as much as the calls which diagonals have more than rows for each column of the longer side.
CALLS = 8_000


def letters(rows: list[str]) -> np.ndarray:
    """The code points of rows of one length."""
    return np.array(rows).view(np.uint32).reshape(len(rows), -1) if rows and rows[0] else np.zeros((len(rows), 0), np.uint32)


def texts(codes: np.ndarray) -> list[str]:
    """The rows of such code points."""
    return np.ascontiguousarray(codes).view(f"<U{codes.shape[1]}")[:, 0].tolist() if codes.size else [""] * len(codes)


class Profile:
    """Weighted letter shares of the columns of an alignment, and what opening and closing a gap there costs."""

    def __init__(self, rows: list[str], weights: np.ndarray):
        w = weights / weights.sum()
        chars = letters(rows)
        n = ((chars == ord("N")) * w[:, None]).sum(axis=0) / 20
        self.shares = np.stack([((chars == ord(x)) * w[:, None]).sum(axis=0) + n for x in LETTERS], axis=1)
        gap = chars == GAP
        before = np.concatenate((np.zeros((len(rows), 1), bool), gap[:, :-1]), axis=1)
        after = np.concatenate((gap[:, 1:], np.zeros((len(rows), 1), bool)), axis=1)
        self.open = (1 - ((gap & ~before) * w[:, None]).sum(axis=0)) * GAP_OPEN / 2
        self.close = (1 - ((gap & ~after) * w[:, None]).sum(axis=0)) * GAP_OPEN / 2
        self.open[0] = self.close[-1] = 0.0  # gaps at the ends are free


def global_path(a: Profile, b: Profile) -> str:
    """Best path of M (both), D (column of a alone), I (column of b alone). Gaps cost their opening and closing only. On ties M comes before D, D before I."""
    return _side_by_side([(a, b)])[0]


def _side_by_side(pairs: list[tuple[Profile, Profile]]) -> list[str]:
    """The best paths of pairs of like size, all with the shorter side in a or all in b. Scores are floats of 32 bits.

    Diagonals take two thirds of the time of rows for a cell, but they are more calls: they pay where many pairs stand side by side.
    """
    n, m = max(len(a.shares) for a, _ in pairs), max(len(b.shares) for _, b in pairs)
    return _by_diagonals(pairs) if len(pairs) * n * m > CALLS * max(n, m) else _by_rows(pairs)


def _by_diagonals(pairs: list[tuple[Profile, Profile]]) -> list[str]:
    """The cells of one antidiagonal (i + j = d, i columns of a, j of b) depend on the two before only, so they are one vector, of all pairs.

    Vectors go by i, then by pair; a row of -1e18 stands before i = 0, and what stands beyond a diagonal's cells has that value too. Columns
    of b are turned round, so that their part of a diagonal is a slice. Padding comes behind each pair's end, where nothing of it comes back.
    """
    k, n, m = len(pairs), max(len(a.shares) for a, _ in pairs), max(len(b.shares) for _, b in pairs)
    in_a, in_b = np.zeros((6, n + 2, k), np.float32), np.zeros((6, m + 1, k), np.float32)
    ends: dict[int, list[int]] = {}
    for p, (a, b) in enumerate(pairs):
        x, y = len(a.shares), len(b.shares)
        in_a[:4, 2 : x + 2, p], in_a[4, 2 : x + 2, p], in_a[5, 2 : x + 2, p] = (a.shares @ SCORES).T, a.open, a.close
        in_b[:4, m - y : m, p], in_b[4, m - y : m, p], in_b[5, m - y : m, p] = b.shares[::-1].T, b.open[::-1], b.close[::-1]
        ends.setdefault(x + y, []).append(p)
    in_a, in_b = in_a.reshape(6, -1), in_b.reshape(6, -1)
    matches, deletes, reached = ([np.full((n + 2) * k, LOW, np.float32) for _ in "12"] for _ in "MDB")
    insert, one, two = np.full((n + 2) * k, LOW, np.float32), *(np.empty((min(n, m) + 1) * k, np.float32) for _ in "12")
    d = np.arange(n + m + 1)
    low, high = np.maximum(d - m, 0).tolist(), np.minimum(d, n).tolist()
    sizes = (np.array(high) - low + 1) * k
    at = (np.cumsum(sizes) - sizes).tolist()
    # of every cell: does a match after it come from a gap (I where both, D where that alone is better), and do the gaps go on
    from_d, from_i, longer_d, longer_i = (np.empty(sizes.sum(), bool) for _ in range(4))
    states = [0] * k
    for d, (first, last, start) in enumerate(zip(low, high, at, strict=True)):
        size = (last - first + 1) * k
        own, before, cell = slice((first + 1) * k, (last + 2) * k), slice(first * k, (last + 1) * k), slice(start, start + size)
        of_a, of_b = in_a[:, own], in_b[:, (m - d + first) * k : (m - d + last + 1) * k]
        x, y = one[:size], two[:size]
        best, delete, gaps, here = reached[d % 2], deletes[d % 2][own], insert[own], matches[d % 2][own]
        old_match, old_delete = matches[d % 2 - 1], deletes[d % 2 - 1][before]
        np.add(old_match[before], of_a[4], out=x)
        np.greater(old_delete, x, out=longer_d[cell])
        np.maximum(old_delete, x, out=delete)
        np.add(old_match[own], of_b[4], out=x)
        np.greater(gaps, x, out=longer_i[cell])
        np.maximum(gaps, x, out=gaps)
        np.multiply(of_a[0], of_b[0], out=x)
        for c in (1, 2, 3):
            np.multiply(of_a[c], of_b[c], out=y)
            np.add(x, y, out=x)
        np.add(x, best[before], out=here)
        if not d:
            here[:] = 0.0
        np.add(delete, of_a[5], out=x)
        np.greater(x, here, out=from_d[cell])
        np.maximum(x, here, out=x)
        np.add(gaps, of_b[5], out=y)
        np.greater(y, x, out=from_i[cell])
        np.maximum(x, y, out=best[own])
        for p in ends.get(d, ()):  # a gap at the end closes for nothing
            i = (len(pairs[p][0].shares) + 1) * k + p
            states[p] = int(np.argmax((matches[d % 2][i], deletes[d % 2][i], insert[i])))
    base = [s - f * k for s, f in zip(at, low, strict=True)]
    marks = [memoryview(x) for x in (from_d, from_i, longer_d, longer_i)]
    return [_walked(states[p], len(a.shares), len(b.shares), False, base, k, p, *marks) for p, (a, b) in enumerate(pairs)]


def _by_rows(pairs: list[tuple[Profile, Profile]]) -> list[str]:
    """A row of cells of every pair is one vector. Rows go over the shorter side (x), a gap in the other (y) is a running maximum."""
    turned = len(pairs[0][0].shares) > len(pairs[0][1].shares)
    pairs = [(b, a) for a, b in pairs] if turned else pairs
    k, n, m = len(pairs), max(len(x.shares) for x, _ in pairs), max(len(y.shares) for _, y in pairs)
    score_x, open_x, close_x = (np.zeros(size, np.float32) for size in ((n, 4, k), (n, k, 1), (n + 1, k, 1)))
    score_y, open_y, close_y = (np.zeros(size, np.float32) for size in ((4, k, m), (k, m), (k, m + 1)))
    ends: dict[int, list[int]] = {}
    for p, (x, y) in enumerate(pairs):
        i, j = len(x.shares), len(y.shares)
        score_x[:i, :, p], open_x[:i, p, 0], close_x[1 : i + 1, p, 0] = x.shares @ SCORES, x.open, x.close
        score_y[:, p, :j], open_y[p, :j], close_y[p, 1 : j + 1] = y.shares.T, y.open, y.close
        ends.setdefault(i, []).append(p)
    match, along_x, along_y = (np.full((k, m + 1), LOW, np.float32) for _ in range(3))
    match[:, 0], along_y[:, 1:] = 0.0, 0.0
    # of every cell: does a match after it come from a gap (of the two kinds the later one that is better), and do the gaps go on
    from_first, from_last, longer_x, longer_y = (np.empty((n + 1, k, m + 1), bool) for _ in range(4))
    longer_y[:, :, :2], longer_y[0, :, 2:] = False, True
    opened, best, other, starts = (np.empty((k, w), np.float32) for w in (m + 1, m + 1, m + 1, m))
    to_match, to_y, before, so_far, later = match[:, 1:], along_y[:, 1:], best[:, :-1], along_y[:, 1:-1], starts[:, 1:]
    behind = match[:, :-1]
    first, last = ((close_y, along_y), (close_x, along_x)) if turned else ((close_x, along_x), (close_y, along_y))  # M before D, D before I
    states = [0] * k
    for i in range(n):
        np.add(first[1], first[0] if turned else first[0][i], out=other)
        np.greater(other, match, out=from_first[i])
        np.maximum(match, other, out=best)
        np.add(last[1], last[0][i] if turned else last[0], out=other)
        np.greater(other, best, out=from_last[i])
        np.maximum(best, other, out=best)
        np.add(match, open_x[i], out=opened)
        np.greater(along_x, opened, out=longer_x[i + 1])
        np.maximum(along_x, opened, out=along_x)
        np.einsum("ck,ckm->km", score_x[i], score_y, out=starts)
        np.add(starts, before, out=to_match)
        match[:, 0] = LOW
        np.add(behind, open_y, out=starts)
        np.maximum.accumulate(starts, axis=1, out=to_y)
        np.greater(so_far, later, out=longer_y[i + 1, :, 2:])
        for p in ends.get(i + 1, ()):  # a gap at the end closes for nothing
            j = len(pairs[p][1].shares)
            gaps = (along_y[p, j], along_x[p, j]) if turned else (along_x[p, j], along_y[p, j])
            states[p] = int(np.argmax((match[p, j], *gaps)))
    if turned:
        longer_x, longer_y = longer_y, longer_x
    marks = [memoryview(x.reshape(-1)) for x in (from_first, from_last, longer_x, longer_y)]
    return [_walked(states[p], len(x.shares), len(y.shares), turned, range(n + m + 1), k * (m + 1) - 1, p * (m + 1), *marks) for p, (x, y) in enumerate(pairs)]


def _walked(state: int, i: int, j: int, turned: bool, base: Sequence[int], step: int, at: int, from_d: memoryview, from_i: memoryview, longer_d: memoryview, longer_i: memoryview) -> str:
    """The path from its end back to its beginning. The marks of a cell stand at base[i + j] + step * i + at; turned: i is of b."""
    out = []
    while i or j:
        if state == 0:
            out.append("M")
            i, j = i - 1, j - 1
            cell = base[i + j] + step * i + at
            state = 2 if from_i[cell] else 1 if from_d[cell] else 0
        else:
            cell = base[i + j] + step * i + at
            out.append("D" if state == 1 else "I")
            if (state == 1) == turned:
                j -= 1
            else:
                i -= 1
            if not (longer_d if state == 1 else longer_i)[cell]:
                state = 0
    return "".join(reversed(out))


def _class(n: int, m: int) -> tuple[int, int, bool]:
    """Sizes of one class differ by a third at most, small ones are one; and the shorter side is the same."""
    size = lambda x: max(math.ceil(math.log(x / SMALL, 4 / 3)), 0)
    return size(n), size(m), n > m


def together(works: Iterable[tuple[int, Generator]], most: int = BESIDE) -> Iterator[tuple[int, object]]:
    """The number of each work, as it ends, and what it returns. A work is a generator that asks for the best path of two sides (rows, weights).

    Works go on side by side, so many that their sizes (letters) come to `most`: of all that is asked, the commonest class of like
    sizes is computed in one, for small vectors cost their calls and not their cells.
    """
    waiting: dict[tuple[int, int, bool], list[tuple]] = {}
    ended: list[tuple[int, object]] = []
    coming, open_ = enumerate(works), 0

    def go_on(i: int, size: int, work: Generator, path: str | None = None) -> int:
        try:
            one, two = work.send(path)
        except StopIteration as end:
            ended.append((i, end.value))
            return size
        waiting.setdefault(_class(len(one[0][0]), len(two[0][0])), []).append((i, size, work, one, two))
        return 0

    while True:
        for i, (size, work) in coming:
            open_ += size - go_on(i, size, work)
            if open_ >= most:
                break
        yield from ended
        ended.clear()
        if not waiting:
            return
        key = max(waiting, key=lambda x: len(waiting[x]))
        asked = waiting.pop(key)
        for near in ((key[0] - 1, *key[1:]), (key[0], key[1] - 1, key[2]), (key[0] - 1, key[1] - 1, key[2])):
            if len(asked) < FEW and near in waiting:
                asked += waiting.pop(near)
        wide, high = (max(len(a[c][0][0]) for a in asked) for c in (3, 4))
        n = max(min(WIDE // max(wide, high), CELLS // (wide * high)), 1)
        for one in asked[n:]:
            waiting.setdefault(_class(len(one[3][0][0]), len(one[4][0][0])), []).append(one)
        for (i, size, work, *_), path in zip(asked[:n], _side_by_side([(Profile(*one), Profile(*two)) for *_, one, two in asked[:n]]), strict=True):
            open_ -= go_on(i, size, work, path)


def alone(work: Generator) -> object:
    """What one work returns."""
    return next(together([(0, work)]))[1]


def path_rows(path: str, a: list[str], b: list[str]) -> list[str]:
    """The rows of both alignments with gaps where the path leaves them out."""
    steps = np.frombuffer(path.encode(), np.uint8)
    out = np.full((len(a) + len(b), len(steps)), GAP, np.uint32)
    out[: len(a), steps != ord("I")] = letters(a)
    out[len(a) :, steps != ord("D")] = letters(b)
    return texts(out)


def align_pair(a: str, b: str) -> tuple[str, str]:
    if not a or not b:
        return a + "-" * len(b), "-" * len(a) + b
    one = np.ones(1)
    x, y = path_rows(global_path(Profile([a], one), Profile([b], one)), [a], [b])
    return x, y


def local_score(a: str, b: str, gap: float = 200.0) -> tuple[float, int, int]:
    """Best local score with linear gaps, and where it ends in each sequence (after the last symbol)."""
    if not a or not b:
        return 0.0, 0, 0
    code = {c: i for i, c in enumerate(LETTERS)}
    table = np.zeros((5, 5))
    table[:4, :4] = SCORES
    y = np.array([code.get(c, 4) for c in b])
    row, best = np.zeros(len(b) + 1), (0.0, 0, 0)
    drift = gap * np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.zeros(len(b) + 1)
        new[1:] = np.maximum(row[:-1] + table[code.get(c, 4)][y], row[1:] - gap)
        new = np.maximum(new, 0.0)
        new = np.maximum.accumulate(new + drift) - drift  # gaps in a
        at = int(new.argmax())
        if new[at] > best[0] + 1e-9:
            best = (float(new[at]), i, at)
        row = new
    return best


class PartialOrder:
    """A graph of aligned symbols; each sequence is aligned to it and threaded through it."""

    def __init__(self, match: int = 5, mismatch: int = -4, gap: int = -8):
        self.match, self.mismatch, self.gap = match, mismatch, gap
        self.symbol: list[str] = []
        self.before: list[list[int]] = []
        self.column: list[float] = []
        self.paths: list[list[int]] = []

    def add(self, seq: str) -> None:
        order = sorted(range(len(self.symbol)), key=lambda v: (self.column[v], v))
        width = len(seq)
        steps = self.gap * np.arange(width + 1)
        score, back = {-1: steps.astype(float)}, {}
        for v in order:
            parents = self.before[v] or [-1]
            hit = np.where(np.array(list(seq)) == self.symbol[v], self.match, self.mismatch) if width else np.zeros(0)
            stack = np.stack([score[p] for p in parents])
            skip, who = stack.max(axis=0) + self.gap, stack.argmax(axis=0)
            diagonal = np.full(width + 1, -1e9)
            diagonal[1:] = stack.max(axis=0)[:-1] + hit
            best = np.maximum(diagonal, skip)
            kind = np.where(diagonal >= skip, 0, 1)
            run = np.maximum.accumulate(best - steps) + steps
            kind = np.where(run > best, 2, kind)
            score[v], back[v] = run, (kind, who, parents)
        ends = [v for v in order if not any(v in b for b in self.before)] or [-1]
        v = max(ends, key=lambda e: (score[e][width], -e))
        at, pairs = width, []
        while v >= 0 or at:
            if v < 0:
                pairs.append((None, at - 1))
                at -= 1
                continue
            kind, who, parents = back[v]
            if kind[at] == 2:
                pairs.append((None, at - 1))
                at -= 1
            elif kind[at] == 0:
                pairs.append((v, at - 1))
                v, at = parents[who[at - 1]], at - 1
            else:
                pairs.append((v, None))
                v = parents[who[at]]
        self._thread(seq, pairs[::-1])

    def _thread(self, seq: str, pairs: list[tuple[int | None, int | None]]) -> None:
        """Walks the alignment: equal symbols share nodes, others get a node in the same column, insertions a column between."""
        columns = sorted(set(self.column))
        path, last, column = [], -1, (columns[0] - 1.0) if columns else 0.0
        following = [self.column[v] if v is not None else None for v, _ in pairs]
        for k, (v, i) in enumerate(pairs):
            if v is not None:
                column = self.column[v]
            if i is None:
                continue
            if v is None:
                nxt = next((c for c in following[k:] if c is not None), None)
                later = [c for c in columns if c > column]
                bound = later[0] if later else None
                bound = nxt if bound is None and nxt is not None else bound
                column = (column + bound) / 2 if bound is not None else column + 1.0
                columns = sorted({*columns, column})
            same = next((u for u in range(len(self.symbol)) if self.column[u] == column and self.symbol[u] == seq[i]), None)
            if same is None:
                same = len(self.symbol)
                self.symbol.append(seq[i])
                self.before.append([])
                self.column.append(column)
            if last >= 0 and last not in self.before[same]:
                self.before[same].append(last)
            path.append(same)
            last = same
        self.paths.append(path)

    def rows(self) -> list[str]:
        columns = sorted(set(self.column))
        place = {c: k for k, c in enumerate(columns)}
        out = []
        for path in self.paths:
            row = ["-"] * len(columns)
            for v in path:
                row[place[self.column[v]]] = self.symbol[v]
            out.append("".join(row))
        return out
