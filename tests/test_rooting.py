"""Roots, splits, pruning and weights on random trees, against walks over the tree."""

import random

import numpy as np
import pytest

from genomill.operators import rooting as R
from genomill.operators.clusters import linked_clusters, shares
from genomill.operators.trees import upgma


def grown(seed, n):
    """(node, parent, length, leaf) of a random tree whose inner nodes have two branches or more, some but one."""
    rng, rows, open_, nodes = random.Random(seed), [], ["root"], 0
    while open_ and nodes < n:
        parent = open_.pop(rng.randrange(len(open_)))
        for _ in range(rng.choice([1, 2, 2, 3]) if parent != "root" else 2):
            nodes += 1
            rows.append([f"v{nodes}", parent, float(rng.randint(1, 9)), True])
            open_.append(f"v{nodes}")
    inner = {r[1] for r in rows}
    return [(v, p, w, v not in inner) for v, p, w, _ in rows]


def walks(rows):
    near = {}
    for v, p, w, _ in rows:
        near.setdefault(v, []).append((p, w))
        near.setdefault(p, []).append((v, w))

    def far(start, banned):
        seen, stack = {start: 0.0}, [start]
        while stack:
            x = stack.pop()
            for y, w in near[x]:
                if y not in seen and {x, y} != banned:
                    seen[y] = seen[x] + w
                    stack.append(y)
        return seen

    leaves = {v for v, _, _, leaf in rows if leaf}
    return {v: ([d for x, d in far(v, {v, p}).items() if x in leaves], [d for x, d in far(p, {v, p}).items() if x in leaves]) for v, p, _, _ in rows}, leaves, far


@pytest.mark.parametrize("seed", [2])
def test_distances_roots_splits(spark, seed):
    rows = grown(seed, 12)
    tree = spark.createDataFrame(rows, "node string, parent string, length double, leaf boolean")
    sides, leaves, far = walks(rows)
    edges = R.edge_distances(tree, spark).collect()
    assert len(edges) == len(rows)
    for e in edges:
        down, up = sides[e.node]
        assert (e.n, e.total, e.most) == (len(down), sum(down), max(down))
        assert (e.n_up, e.total_up or 0, e.most_up or 0) == (len(up), sum(up), max(up, default=0))
    found = {r.rule: r for r in R.roots(R.edge_distances(tree, spark)).collect()}
    longest = max(far(a, set())[b] for a in leaves for b in leaves)
    span = found["span"]
    assert span.low + span.high == pytest.approx(next(w for v, _, w, _ in rows if v == span.node)) and span.height == pytest.approx(longest / 2)
    if mean := found.get("mean"):
        down, up = sides[mean.node]
        assert np.mean(down) + mean.low == pytest.approx(np.mean(up) + mean.high)
    splits = {r.node: r for r in R.bipartitions(tree, spark).collect()}
    under = {v: {x for x in far(v, {v, p}) if x in leaves} for v, p, _, _ in rows}
    same = {}
    for v, r in splits.items():
        side = min(under[v], leaves - under[v], key=lambda s: (len(s), s != under[v]))
        assert r.n == len(side)
        assert same.setdefault(r.part, side) == side or len(side) * 2 == len(leaves)


@pytest.mark.parametrize("seed", [2])
def test_pruned_trees_keep_distances(spark, seed):
    rows = grown(seed + 10, 14)
    tree = spark.createDataFrame(rows, "node string, parent string, length double, leaf boolean")
    _, leaves, far = walks(rows)
    rng = random.Random(seed)
    kept = sorted(rng.sample(sorted(leaves), max(2, len(leaves) // 2)))
    got = [tuple(r) for r in R.pruned(tree, spark.createDataFrame([(k,) for k in kept], "node string"), spark).collect()]
    assert len({r[0] for r in got}) == len(got)
    _, left, new_far = walks([(v, p, w, v in kept) for v, p, w in got])
    below = {}
    for _, p, _ in got:
        below[p] = below.get(p, 0) + 1
    assert all(n > 1 for p, n in below.items() if p != "root") and left == set(kept)
    for a in kept:
        want, have = far(a, set()), new_far(a, set())
        assert all(have[b] == pytest.approx(want[b]) for b in kept)


def test_shares_add_up_and_favour_the_lonely():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        d = rng.random((n, n))
        d = (d + d.T) / 2
        w = shares(upgma(d, "min"))
        assert w.sum() == pytest.approx(1) and (w > 0).all()
    alike = np.array([[0, 0.1, 0.9], [0.1, 0, 0.9], [0.9, 0.9, 0]])
    w = shares(upgma(alike, "min"))
    assert w[0] == pytest.approx(w[1]) and w[2] > 0.4
    assert shares(upgma(np.zeros((4, 4)), "min")) == pytest.approx([0.25] * 4)


def test_linked_clusters(spark):
    rng, links = random.Random(3), []
    for s in range(5):
        links += [(s, *sorted(rng.sample(range(30), 2), reverse=True)) for _ in range(18)]
    rows = spark.createDataFrame([(s, i) for s in range(6) for i in range(30)], "set_id long, seq_id long")
    got = {(r.set_id, r.seq_id): r for r in linked_clusters(rows, spark.createDataFrame(links, "set_id long, a long, b long")).collect()}
    for s in range(6):
        up = list(range(30))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for t, a, b in links:
            if t == s and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
        size = [sum(find(j) == find(i) for j in range(30)) for i in range(30)]
        assert [(got[s, i].cluster, got[s, i].weight, got[s, i].effective) for i in range(30)] == [(find(i), 1 / size[i], len({find(j) for j in range(30)})) for i in range(30)]
