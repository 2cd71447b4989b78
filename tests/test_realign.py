"""Realigning what differs against full runs; three-way weights against walks over the tree without its root."""

import random
from math import sqrt

import numpy as np
import pytest

from genomill.operators import realign as R
from genomill.operators.trees import upgma


def sets(spark, seed=1):
    rng, rows = random.Random(seed), []
    for s in range(6):
        base = "".join(rng.choice("ACGT") for _ in range(40))
        for i in range([0, 1, 2, 5, 8, 9][s]):
            own = list(base)
            for _ in range(rng.randrange(12)):
                at = rng.randrange(len(own))
                own[at] = rng.choice(["", "A", "C", "GG", "T"])
            rows.append((s, 10 * s + i, "".join(own), 0.5 + rng.random()))
    rows += [(7, 1, "", 1.0), (7, 2, "ACGT", 1.0), (8, 3, "", 1.0), (9, 4, "ACGT", 1.0), (9, 5, "ACGT", 1.0)]
    return spark.createDataFrame(rows, "set_id long, seq_id long, seq string, weight double")


def test_realigned_is_the_full_run_with_fewer_merges(spark):
    s = sets(spark)
    old = R.tree_nodes(s, R.kmer_tree)
    first = R.aligned_along(s, old).join(s.select("set_id", "seq_id", "weight"), ["set_id", "seq_id"])
    new = R.tree_nodes(first, R.identity_tree)
    got, made = R.realigned(first, old, new)
    want = R.aligned_along(s, new)
    rows = lambda df: {(r.set_id, r.seq_id): r.seq for r in df.collect()}
    got, want, bare = rows(got), rows(want), rows(s)
    assert got == want and {k: v.replace("-", "") for k, v in got.items()} == bare
    assert {len({len(v) for k, v in got.items() if k[0] == g}) for g in {k[0] for k in got}} == {1}
    merges = new.where("level > 0").count()
    assert 0 < made.count() < merges
    same, none = R.realigned(first, old, old)
    assert none.count() == 0 and rows(same) == rows(first)


def test_empty_table(spark):
    s = sets(spark).limit(0)
    nodes = R.tree_nodes(s, R.kmer_tree)
    assert R.aligned_along(s, nodes).count() == 0 and R.realigned(s, nodes, nodes)[0].count() == 0


def slow_edges(tree):
    """The definition, by walking the tree without its root."""
    near = {}
    edge = lambda a, b, w: (near.setdefault(a, {}).update({b: w}), near.setdefault(b, {}).update({a: w}))
    for k, pair in enumerate(tree.children):
        if tree.n + k == tree.root:
            edge(*pair, sum(max(tree.length[c], 0) for c in pair))
        else:
            for c in pair:
                edge(tree.n + k, c, max(tree.length[c], 0))

    def long(a, b):
        rest = [long(b, c) for c in near[b] if c != a]
        return near[a][b] + (rest[0] * rest[1] / sum(rest) if rest and sum(rest) else 0)

    def at(r, x):
        if len(near[r]) < 3:
            return 1.0
        a, (b, c) = long(r, x), [long(r, y) for y in near[r] if y != x]
        y = a * (b + c) * (a * b + b * c + c * a)
        return sqrt(b * c * (a + b) * (a + c) / y) if y >= 0.001 else 1.0

    return {frozenset((a, b)): at(a, b) * at(b, a) for a in near for b in near[a]}


@pytest.mark.parametrize("seed", range(30))
def test_three_way_weights(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 12))
    d = rng.integers(1, 30, (n, n)).astype(float)
    tree = upgma(np.minimum(d, d.T), "avg" if seed % 2 else "min")
    above, slow = tree.parent(), slow_edges(tree)
    for v, w in R.three_way(tree).items():
        ends = frozenset((v, above[v])) if above[v] != tree.root else frozenset(tree.children[-1])
        assert w == pytest.approx(slow[ends])
    weights = R.three_way_weights(tree)
    assert len(weights) == n and weights.sum() == pytest.approx(1) and (weights >= 0).all()


def test_three_way_of_few_leaves():
    assert R.three_way_weights(upgma(np.zeros((1, 1)))).tolist() == [1.0]
    assert R.three_way_weights(upgma(np.zeros((2, 2)))).tolist() == [0.5, 0.5]
    assert R.three_way_weights(upgma(np.zeros((0, 0)))).tolist() == []
