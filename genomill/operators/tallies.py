"""Sums over the columns of alignments, made from whole rows: a row travels as one string, never as one record a letter.

Rows are sorted by their set and stream through the task, which holds the sums of one set (some numbers a column) however
many rows it has. Letters and gaps are ASCII.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: Letters, N, gap and all else; a column's sums stand in this order, those of gap transitions behind them.
CLASSES = ["n_a", "n_c", "n_g", "n_t", "n_n", "n_gap", "n_other"]
#: Shares of rows that go from letter or gap to letter or gap, and of those whose gap ends here (`le`); off the ends a row has no gap.
MOVES = ["ll", "lg", "gl", "gg", "le"]
GAP = CLASSES.index("n_gap")

_CLASS = np.full(256, 6, np.uint8)
for _i, _x in enumerate(["A", "C", "G", "T", "N", "-."]):
    _CLASS[np.frombuffer(_x.encode(), np.uint8)] = _i

#: Rows of output sent at once.
SENT = 1 << 14


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings in a row, and where each begins; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of rows with equal keys."""
    n = len(keys[0])
    if not n:
        return []
    new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    ends = [0, *new.tolist(), n]
    return list(zip(ends[:-1], ends[1:], strict=True))


def sums_of(codes: np.ndarray, weight: np.ndarray | None, moves: bool) -> np.ndarray:
    """The sums of rows of one length (rows x columns of class numbers)."""
    total = (lambda x: x.sum(0, dtype=np.float64)) if weight is None else (lambda x: weight @ x)
    out = [total(codes == c) for c in range(len(CLASSES))]
    if moves:
        gap = codes == GAP
        before, after = np.zeros_like(gap), np.zeros_like(gap)
        before[:, 1:], after[:, :-1] = gap[:, :-1], gap[:, 1:]
        out += [total(x) for x in (~before & ~gap, ~before & gap, before & ~gap, before & gap, ~after & gap)]
    return np.array(out)


def tallied(rows: DataFrame, make: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, group: str = "set_id", moves: bool = False, weight: bool = False, halves: bool = False) -> DataFrame:
    """group and the columns of `schema`: what `make` makes of the sums of each group's rows (group, seq_id, seq, with `weight` also weight).

    Sums: CLASSES, with `moves` MOVES; with `weight` weighted, and behind them those of squared weights (CLASSES). With
    `halves` an array of two such tables, of the even and of the odd seq_ids. `make` gives arrays of one length, a row of output each.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kind = rows.schema[group].dataType.simpleString()
    n_sums = len(CLASSES) + (len(MOVES) if moves else 0) + (len(CLASSES) if weight else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, parts, waiting = None, None, [], 0

        def sent() -> pa.RecordBatch:
            keys = pa.array(np.repeat([k for k, *_ in parts], [n for _, n, _ in parts]))
            return pa.RecordBatch.from_arrays([keys, *(pa.concat_arrays([pa.array(p[c]) if not isinstance(p[c], pa.Array) else p[c] for *_, p in parts]) for c in names)], names=[group, *names])

        def closed() -> int:
            made = make(sums if halves else sums[0])
            n = len(made[names[0]])
            if n:
                parts.append((now, n, made))
            return n

        for batch in batches:
            if not len(batch):
                continue
            data, at = text_of(batch.column("seq"))
            codes, length = _CLASS[data], np.diff(at)
            keys = batch.column(group).to_numpy()
            half = batch.column("seq_id").to_numpy() % 2 if halves else np.zeros(len(keys), np.int64)
            w = batch.column("weight").to_numpy() if weight else None
            for i, j in runs(keys, half, length):
                if now is None or keys[i] != now:
                    if now is not None:
                        waiting += closed()
                        if waiting >= SENT:
                            yield sent()
                            parts, waiting = [], 0
                    now, sums = keys[i], np.zeros((2 if halves else 1, n_sums, 0))
                width = int(length[i])
                if width > sums.shape[2]:
                    sums = np.concatenate([sums, np.zeros((*sums.shape[:2], width - sums.shape[2]))], axis=2)
                own = codes[at[i] : at[j]].reshape(j - i, width)
                found = sums_of(own, None if w is None else w[i:j], moves)
                if w is not None:
                    found = np.concatenate([found, sums_of(own, w[i:j] ** 2, False)])
                sums[half[i], :, :width] += found
        if now is not None:
            closed()
        if parts:
            yield sent()

    # a number within the group: rows come together and in order, and are shuffled only where they aren't by group yet
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.col("seq_id") % 2 if halves else F.lit(0)))
    return rows.select(group, "seq_id", "seq", *(["weight"] if weight else []), nth.alias("nth")).mapInArrow(run, f"{group} {kind}, {schema}")


def counts(s: np.ndarray) -> dict[str, np.ndarray]:
    """n_seqs and the number of rows of every class, a row a column."""
    whole = s[: len(CLASSES)].astype(np.int64)
    return {"col": np.arange(s.shape[1], dtype=np.int32), "n_seqs": whole.sum(0), **dict(zip(CLASSES, whole, strict=True))}


COUNTS = "col int, n_seqs long, " + ", ".join(f"{c} long" for c in CLASSES[:-1])


def column_counts(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, col (from 0), n_seqs, n_a, n_c, n_g, n_t, n_n, n_gap of every column."""
    return tallied(rows, counts, COUNTS, group)


def paired(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, a, b (b < a), both (columns without gap in either), same: two rows of a group, a pair a row.

    Rows that repeat a seq_id count together; pairs without a common column are left out.
    """
    keyed = rows.select(group, "seq_id", "seq")
    x, y = keyed.select(group, F.col("seq_id").alias("a"), F.col("seq").alias("x")), keyed.select(group, F.col("seq_id").alias("b"), F.col("seq").alias("y"))
    kind, ids = rows.schema[group].dataType.simpleString(), rows.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (p, at), (q, bt) = text_of(batch.column("x")), text_of(batch.column("y"))
            if not np.array_equal(at, bt):  # rows of unlike lengths: what both have
                least = np.minimum(np.diff(at), np.diff(bt))
                ct = np.concatenate([[0], np.cumsum(least)])
                inside = np.arange(ct[-1]) - np.repeat(ct[:-1], least)
                p, q, at = p[np.repeat(at[:-1], least) + inside], q[np.repeat(bt[:-1], least) + inside], ct
            real = (_CLASS[p] != GAP) & (_CLASS[q] != GAP)
            count = lambda hit, at=at: np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
            both, same = count(real), count(real & (p == q))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (group, "a", "b")), pa.array(both, pa.int64()), pa.array(same, pa.int64())], names=[group, "a", "b", "both", "same"]).filter(pa.array(both > 0))

    found = x.join(y, group).where("b < a").mapInArrow(run, f"{group} {kind}, a {ids}, b {ids}, both long, same long")
    return found.groupBy(group, "a", "b").agg(F.sum("both").alias("both"), F.sum("same").alias("same"))


def position_worth(s: np.ndarray) -> dict[str, list]:
    """What a letter is worth by its column, as one value a set: the least whole numbers that hold types * rows, 0 for gaps."""
    n = s[[i for i in range(len(CLASSES)) if i != GAP]]
    worth = n * (n > 0).sum(0)
    most = int(worth.max()) if worth.size else 0
    size = next(b for b in (1, 2, 4, 8) if most < 1 << (8 * b - 1))
    return {"size": np.array([size], np.int32), "worth": pa.array([worth.astype(f"<i{size}").T.tobytes()], pa.binary())}


def position_weights(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, raw: the sum over a row's letters of 1 / (kinds of letters in the column * rows with this one). Rows without letters are left out."""
    keyed = rows.select(group, "seq_id", "seq")
    worth = tallied(keyed, position_worth, "size int, worth binary", group)
    kind, ids = rows.schema[group].dataType.simpleString(), rows.schema["seq_id"].dataType.simpleString()
    place = np.array([0, 1, 2, 3, 4, 0, 5])  # of a class in `worth`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_of(batch.column("seq"))
            codes, raw, real = _CLASS[data], np.zeros(len(batch)), np.zeros(len(batch), bool)
            last, table = None, None
            keys, sizes = batch.column(group).to_numpy(), batch.column("size").to_numpy()
            for i in range(len(batch)):
                if last is None or keys[i] != last:
                    last = keys[i]
                    whole = np.frombuffer(batch.column("worth")[i].as_buffer(), f"<i{sizes[i]}").reshape(-1, 6)
                    table = np.divide(1.0, whole, out=np.zeros(whole.shape), where=whole > 0)
                own = codes[at[i] : at[i + 1]]
                letters = own != GAP
                raw[i], real[i] = table[np.flatnonzero(letters), place[own[letters]]].sum(), letters.any()
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("seq_id"), pa.array(raw)], names=[group, "seq_id", "raw"]).filter(pa.array(real))

    return keyed.join(worth, group).select(group, "seq_id", "seq", "size", "worth").mapInArrow(run, f"{group} {kind}, seq_id {ids}, raw double").groupBy(group, "seq_id").agg(F.sum("raw").alias("raw"))
