"""Refinement and anchored blocks: bare sequences stay, scores never fall, and the rows of many tasks are those of one call."""

import random
from itertools import combinations

import numpy as np
import pytest

from genomill.operators.blocks import anchored_alignment
from genomill.operators.columns import GAP_OPEN, pair_score
from genomill.operators.extension import block_alignment
from genomill.operators.objectives import score_pair
from genomill.operators.refine import cross_score, cuts, refine, refined, refined_between, tree_of
from genomill.operators.trees import multiple_alignment


def family(rng, n, size):
    base = [rng.choice("ACGT") for _ in range(size)]
    return ["".join(c if rng.random() > 0.15 else rng.choice(["", "A", "CG", "T"]) for c in base) for _ in range(n)]


def naive_pair(a, b):
    cols = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
    letters = sum(pair_score(x, y) for x, y in cols if "-" not in (x, y))
    gaps, one, two = 0.0, False, False
    for i, (x, y) in enumerate(cols):
        if x == "-":
            gaps, one = gaps + (0 if one else GAP_OPEN / 2 if i == 0 else GAP_OPEN), True
        elif y == "-":
            gaps, two = gaps + (0 if two else GAP_OPEN / 2 if i == 0 else GAP_OPEN), True
        else:
            one = two = False
    return letters, gaps - (GAP_OPEN / 2 if one or two else 0)


def test_pair_score_column_by_column():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randint(0, 12)
        a, b = ("".join(rng.choice("AC--N") for _ in range(n)) for _ in range(2))
        assert score_pair(a, b) == pytest.approx(naive_pair(a, b)), (a, b)


def whole(rows, w):
    return sum(w[i] * w[j] * sum(naive_pair(rows[i], rows[j])) for i, j in combinations(range(len(rows)), 2))


def test_refinement_never_scores_less():
    rng, gained = random.Random(2), 0
    for _ in range(40):
        seqs = family(rng, rng.randint(1, 6), rng.choice([3, 20, 60]))
        start = multiple_alignment(seqs) if rng.random() < 0.5 else [s.ljust(max(map(len, seqs)), "-") for s in seqs]
        tree, w = tree_of(start)
        rows, accepted = refine(start, tree, w)
        assert [r.replace("-", "") for r in rows] == seqs and len({len(r) for r in rows}) == 1
        assert whole(rows, w) >= whole(start, w) - 1e-6 and (accepted == 0) == (rows == start)
        gained += whole(rows, w) > whole(start, w) + 1e-6
        again = refine(rows, tree, w, rounds=1)
        assert accepted >= 8 or again[1] == 0 or whole(again[0], w) > whole(rows, w)
    assert gained > 8


def test_cuts_part_all_rows_and_cross_scores_are_what_changes():
    rng = random.Random(3)
    seqs = family(rng, 6, 30)
    rows = multiple_alignment(seqs)
    tree, w = tree_of(rows)
    edges = cuts(tree)
    assert len(edges) == 2 * 5 - 1 and all(0 < len(e) < 6 for e in edges) and {tuple(sorted(e)) for e in edges} >= {(i,) for i in range(6)} - {tuple(sorted(set(range(6)) - set(e))) for e in edges}
    one, two = edges[0], [i for i in range(6) if i not in edges[0]]
    same = sum(w[i] * w[j] * sum(naive_pair(rows[i], rows[j])) for g in (one, two) for i, j in combinations(g, 2))
    assert cross_score(rows, one, two, w) + same == pytest.approx(whole(rows, w))


def test_refinement_of_sets_and_between_anchors(spark):
    rng, data = random.Random(4), []
    sets = {i: family(rng, rng.randint(1, 5), 40) for i in range(12)}
    for i, seqs in sets.items():
        data += [(i, k, r) for k, r in enumerate(s.ljust(max(map(len, seqs)), "-") for s in seqs)]
    aln = spark.createDataFrame(data, "set_id long, seq_id long, seq string")
    got = {}
    for r in refined(aln, ["set_id"]).orderBy("set_id", "seq_id").collect():
        got.setdefault(r.set_id, []).append(r.seq)
    assert got == {i: refine(s, *tree_of(s))[0] for i in sets for s in [[d[2] for d in data if d[0] == i]]}
    anchors = spark.createDataFrame([(i, c) for i in range(10) for c in (0, 10, 25)], "set_id long, col int")
    for r in refined_between(aln, anchors).collect():
        assert r.seq.replace("-", "") == sets[r.set_id][r.seq_id]
    parts = refined_between(aln, anchors).where("set_id = 11").orderBy("seq_id").collect()
    assert [r.seq for r in parts] == got[11]  # without anchors the whole


def test_anchored_rows_are_those_of_one_call(spark):
    rng = random.Random(5)
    sets = {i: family(rng, rng.randint(2, 4), rng.choice([10, 80, 150])) for i in range(15)}
    rows = [(i, k, s) for i, seqs in sets.items() for k, s in enumerate(seqs)]
    got = {}
    for r in anchored_alignment(spark.createDataFrame(rows, "set_id long, place int, seq string")).orderBy("set_id", "place").collect():
        got.setdefault(r.set_id, []).append(r.seq)
    assert got == {i: block_alignment(seqs) for i, seqs in sets.items()}
    assert any(c.islower() for rows in got.values() for r in rows for c in r) and np.all([len({len(r) for r in rows}) == 1 for rows in got.values()])
