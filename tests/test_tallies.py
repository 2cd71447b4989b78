"""Sums over columns from whole rows: no record a letter is made, whatever the rows."""

import random
from collections import Counter

import pytest

import __spark_entry__ as entry
from conftest import DATA
from genomill.operators import columns as C


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_rows(seed: int) -> list[tuple[int, int, str]]:
    """Sets of unlike sizes and rows of unlike lengths, an empty one and one of gaps."""
    rng = random.Random(seed)
    rows = [(s, s * 100 + i, "".join(rng.choice("ACGTN--") for _ in range(rng.randint(5, 30)))) for s in range(12) for i in range(rng.randint(1, 9))]
    return [*rows, (3, 398, ""), (3, 399, "---"), (20, 2000, "-" * 7)]


@pytest.mark.parametrize("name", ["henikoff_weights", "aln_identity", "kimura_distance", "log_distance", "gsc_weights", "gsc_weight_sums", "objective_sp", "objective_sp_fast", "objective_xp", "objective_ps", "objective_dp", "letter_counts", "column_profile", "indel_stop", "anchor_ranges", "window_smooth", "clustal_output", "gapless_columns", "column_scores", "sum_of_pairs", "trim_columns", "core_snps", "aln_occupancy", "snp_matrix", "aln_conservation"])
def test_rows_are_not_cut_into_letters(spark, name):
    assert "Generate" not in plan_of(entry.queries()[name](spark, DATA))


def test_pairs_of_rows(spark):
    rows = odd_rows(1)
    got = {(r.set_id, r.a, r.b): (r.both, r["same"]) for r in C.pair_identity(spark.createDataFrame(rows, "set_id long, seq_id long, seq string")).collect()}
    want = {}
    for s, a, x in rows:
        for t, b, y in rows:
            both = [(p, q) for p, q in zip(x, y) if "-" not in (p, q)]
            if s == t and b < a and both:
                want[s, a, b] = len(both), sum(p == q for p, q in both)
    assert got == want


def test_position_weights(spark):
    rows = odd_rows(2)
    got = {r.seq_id: r.weight for r in C.henikoff_weights(spark.createDataFrame(rows, "set_id long, seq_id long, seq string")).collect()}
    n = Counter((s, k, ch) for s, _, x in rows for k, ch in enumerate(x) if ch != "-")
    types = Counter((s, k) for s, k, _ in n)
    raw = {i: (s, sum(1 / (types[s, k] * n[s, k, ch]) for k, ch in enumerate(x) if ch != "-")) for s, i, x in rows if x.strip("-")}
    total = Counter()
    for s, w in raw.values():
        total[s] += w
    assert got == pytest.approx({i: w / total[s] for i, (s, w) in raw.items()})


def test_marks_are_those_of_the_columns(spark):
    q = entry.queries()["aln_occupancy"](spark, DATA).collect()
    want = {}
    for r in sorted(q, key=lambda r: (r.set_id, r.col)):
        want[r.set_id] = want.get(r.set_id, "") + r.mark
    from genomill.plans.alignments import aln

    assert {r.set_id: r.marks for r in C.marks(aln(spark, DATA)).collect()} == want


def test_a_row_alone_has_no_pairs(spark):
    rows = spark.createDataFrame([(1, 1, "ACGT"), (2, 2, "AA"), (2, 3, "AC"), (3, 4, "NN"), (3, 5, "NN")], "set_id long, seq_id long, seq string")
    assert sorted(map(tuple, C.sum_of_pairs(rows).collect())) == [(2, 151 - 54), (3, 0)]
