"""Alignments as columns: one row for each sequence and column, aggregated by column or by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.operators.tallies import CLASSES, COUNTS, GAP, MOVES, column_counts, counts, paired, position_weights, tallied, text_of

# Substitution scores of nucleotides, 60 added.
NUC_SCORES = {"AA": 151, "CC": 160, "GG": 160, "TT": 151, "AC": -54, "AG": 29, "AT": -63, "CG": -65, "CT": 29, "GT": -54}
GAP_OPEN = -400.0


def pair_score(a: str, b: str) -> int:
    return NUC_SCORES.get(a + b, NUC_SCORES.get(b + a, 0))


def padded(s: DataFrame, group: str = "set_id") -> DataFrame:
    """Every sequence of a group as long as its longest: an alignment without inner gaps."""
    width = s.groupBy(group).agg(F.max(F.length("seq")).alias("width"))
    return s.join(width, group).withColumn("seq", F.rpad("seq", F.col("width"), F.lit("-"))).drop("width")


def columns(aln: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, col (from 0), ch."""
    return aln.select(group, "seq_id", F.posexplode(F.split("seq", "(?!^)")).alias("col", "ch")).where(F.col("ch") != "")


def is_gap(ch: Column) -> Column:
    return ch.isin("-", ".")


def described(counts: DataFrame) -> DataFrame:
    """Adds consensus, conservation, occupancy and n_types to counts of each letter and of gaps in a column.

    The consensus is the commonest letter, the first by code point of several, N in an all-gap column.
    """
    letters = F.col("n_seqs") - F.col("n_gap")
    top = F.greatest("n_a", "n_c", "n_g", "n_t", "n_n")
    consensus = F.when(letters == 0, "N").when(F.col("n_a") == top, "A").when(F.col("n_c") == top, "C").when(F.col("n_g") == top, "G").when(F.col("n_n") == top, "N").otherwise("T")
    types = sum(((F.col(f"n_{x}") > 0).cast("int") for x in "cgtn"), (F.col("n_a") > 0).cast("int"))
    return counts.withColumns({"consensus": consensus, "conservation": top / F.col("n_seqs"), "occupancy": letters / F.col("n_seqs"), "n_types": types})


def profile(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """The described columns of alignments (group, seq_id, seq)."""
    return described(column_counts(rows, group))


def snps(prof: DataFrame) -> DataFrame:
    """Columns without gap or N that hold at least two bases."""
    return prof.where((F.col("n_gap") == 0) & (F.col("n_n") == 0) & (F.col("n_types") > 1))


def weighted_profile(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """Fractional counts with uniform weights, gap transitions and gap penalties of each column of alignments (group, seq_id, seq).

    N counts a twentieth for each base. ll, lg, gl, gg: shares of sequences that go from letter or gap to letter or gap.
    """

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        return counts(s) | dict(zip(MOVES, s[len(CLASSES) :], strict=True))

    t = tallied(rows, made, COUNTS + "".join(f", {c} double" for c in MOVES), group, moves=True)
    n = F.col("n_seqs")
    found = t.select(
        group, "col", *(((F.col(f"n_{x}") + F.col("n_n") / 20) / n).alias(f"f_{x}") for x in "acgt"), *((F.col(c) / n).alias(c) for c in MOVES[:4]),
        ((1 - F.col("lg") / n) * GAP_OPEN / 2).alias("gap_open"), ((1 - F.col("le") / n) * GAP_OPEN / 2).alias("gap_close"),
    )
    for x in "ACGT":
        found = found.withColumn(f"score_{x.lower()}", sum((F.col(f"f_{y.lower()}") * pair_score(x, y) for y in "CGT"), F.col("f_a") * pair_score(x, "A")))
    return found


def pair_identity(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, a, b (b < a), both (columns without gap in either), same, identity, from whole rows (group, seq_id, seq)."""
    return paired(rows, group).withColumn("identity", F.col("same") / F.col("both"))


def _smooth(c: dict[str, np.ndarray], window: int, ceiling: float) -> tuple[np.ndarray, np.ndarray]:
    """Conservation of each column, and the mean of it, capped, in an odd window around the column; 0 where the window leaves the alignment."""
    conservation = np.max([c[x] for x in CLASSES[:GAP]], axis=0) / np.maximum(c["n_seqs"], 1)
    value, smooth = np.minimum(conservation, ceiling), np.zeros(len(conservation))
    if len(value) >= window:
        smooth[window // 2 : len(value) - window // 2] = sum(value[i : len(value) - window + 1 + i] for i in range(window)) / window
    return conservation, smooth


def smoothed(rows: DataFrame, group: str = "set_id", window: int = 7, ceiling: float = 1.0) -> DataFrame:
    """The described columns and `smooth`, the mean of capped conservation in an odd window around each column; 0 where the window leaves the alignment."""

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        c = counts(s)
        return c | {"smooth": _smooth(c, window, ceiling)[1]}

    return described(tallied(rows, made, COUNTS + ", smooth double", group))


def anchors(rows: DataFrame, group: str = "set_id", window: int = 7, ceiling: float = 1.0, least: float = 0.4, smooth: float = 0.42) -> DataFrame:
    """group, from_col, to_col: columns without gaps that are conserved by themselves and with those around them, and the next such column, null behind the last."""

    def made(s: np.ndarray) -> dict[str, pa.Array]:
        c = counts(s)
        own, around = _smooth(c, window, ceiling)
        at = np.flatnonzero((own >= least) & (around >= smooth) & (c["n_gap"] == 0)).astype(np.int32)
        return {"from_col": pa.array(at), "to_col": pa.array([*at[1:].tolist(), None][: len(at)], pa.int32())}

    return tallied(rows, made, "from_col int, to_col int", group)


def henikoff_weights(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """Position-based weights: a letter is worth 1 / (types in its column * sequences with it); normalised in the group of rows (group, seq_id, seq)."""
    raw = position_weights(rows, group)
    return raw.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy(group))).drop("raw")


def sum_of_pairs(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """Letter part of the sum-of-pairs score, from column counts: no pair of sequences is made."""
    score = np.array([[pair_score(x, y) for y in "ACGT"] for x in "ACGT"])

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        n = s[:4].astype(np.int64)
        pairs = n[:, None] * n[None]
        each = np.array([[pairs[i, j] if j > i else n[i] * (n[i] - 1) // 2 if i == j else 0 * n[i] for j in range(4)] for i in range(4)])
        held = (s[: len(CLASSES)].sum(0) > 1).any()  # a row alone makes no pair
        return {"letters": np.full(int(held), (each * score[:, :, None]).sum(), np.int64)}

    return tallied(rows, made, "letters long", group)


def indel_stop(rows: DataFrame, group: str = "set_id", run: int = 10, share: float = 0.5, least: int = 10) -> DataFrame:
    """Where an alignment is cut: `run` columns in a row with more than `share` gaps end it, one column before they begin; null if nothing ends it, 0 if too little is left."""

    def made(s: np.ndarray) -> dict[str, np.ndarray]:
        c = counts(s)
        gappy = np.concatenate([[0], np.cumsum(c["n_gap"] / np.maximum(c["n_seqs"], 1) > share)])
        ends = np.flatnonzero(gappy[run:] - gappy[:-run] == run) + run - 1 if len(gappy) > run else []
        return {"at": pa.array([int(ends[0]) if len(ends) else None][: int(s.shape[1] > 0)], pa.int32())}

    cut = F.greatest(F.col("at") - run, F.lit(0))
    return tallied(rows, made, "at int", group).select(group, F.when(F.col("at").isNotNull(), F.when(cut < least, 0).otherwise(cut)).alias("cut"))


def trimmed(aln: DataFrame, ref: DataFrame, group: str = "set_id") -> DataFrame:
    """Cuts an alignment to an interval of its reference record: columns from the first with `start` + 1 reference bases to
    the one with `end`. ref: group, ref_id, start, end (half-open, in bases of the reference)."""
    kind = aln.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_of(batch.column("seq"))
            found = []
            for i, (start, end) in enumerate(zip(batch.column("start").to_pylist(), batch.column("end").to_pylist(), strict=True)):
                row = data[at[i] : at[i + 1]]
                bases = np.cumsum(~np.isin(row, [45, 46]))
                ends = [int(np.searchsorted(bases, n)) for n in (start + 1, end)]
                found.append([*(k if k < len(row) else None for k in ends), len(row) - 1])
            yield pa.RecordBatch.from_arrays([batch.column(group), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], names=[group, "first", "last", "width"])

    own = aln.join(ref, group).where("seq_id = ref_id").select(group, "seq", "start", "end").where("seq <> ''")
    span = own.mapInArrow(run, f"{group} {kind}, first int, last int, width int").groupBy(group).agg(F.min("first").alias("first"), F.min("last").alias("last"), F.max("width").alias("width"))
    return aln.join(span, group).where("first is not null").select(group, "seq_id", F.substr("seq", F.col("first") + 1, F.coalesce("last", "width") - F.col("first") + 1).alias("seq"), "first")


def at_columns(rows: DataFrame, test: Callable[[dict[str, np.ndarray]], np.ndarray], group: str = "set_id") -> DataFrame:
    """group, seq_id, seq, at: every row with the columns of its group whose counts pass `test`, in order; groups without any are left out."""
    held = tallied(rows, lambda s: {"at": pa.array([np.flatnonzero(test(counts(s)))], pa.list_(pa.int32()))}, "at array<int>", group).where(F.size("at") > 0)
    return rows.join(held, group).withColumn("at", F.filter("at", lambda c: c < F.length("seq"))).where(F.size("at") > 0)


def letters_at(held: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, at, letters: what rows (group, seq_id, seq, at) have in their columns `at`; by byte, as a text is searched from its start for each of its letters."""
    kind, ids = (held.schema[c].dataType.simpleString() for c in (group, "seq_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data, start), places = text_of(batch.column("seq")), batch.column("at")
            n = np.diff(places.offsets.to_numpy())
            edges = np.concatenate([[0], np.cumsum(n)])
            own = data[np.repeat(start[:-1], n) + places.flatten().to_numpy()].tobytes().decode()
            letters = pa.array([own[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(group), batch.column("seq_id"), places, letters], names=[group, "seq_id", "at", "letters"])

    return held.select(group, "seq_id", "seq", "at").mapInArrow(run, f"{group} {kind}, seq_id {ids}, at array<int>, letters string")


def is_snp(n: dict[str, np.ndarray]) -> np.ndarray:
    """As `snps`."""
    return (n["n_gap"] == 0) & (n["n_n"] == 0) & (sum((n[f"n_{x}"] > 0).astype(int) for x in "acgt") > 1)


def marks(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """group, marks: a text a group with a mark of each column's conservation: one letter (*), one chemical class (:) or neither."""

    def made(s: np.ndarray) -> dict[str, pa.Array]:
        n = counts(s)
        full, types = n["n_gap"] == 0, sum((n[c] > 0).astype(int) for c in CLASSES[:GAP])
        alike = (n["n_a"] + n["n_g"] == n["n_seqs"]) | (n["n_c"] + n["n_t"] == n["n_seqs"])
        text = np.where(full & (types == 1), ord("*"), np.where(full & (n["n_n"] == 0) & alike, ord(":"), ord(" "))).astype(np.uint8)
        return {"marks": pa.array([text.tobytes().decode()] if len(text) else [], pa.string())}

    return tallied(rows, made, "marks string", group)
