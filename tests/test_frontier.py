"""The recursive search as a frontier of regions against the same search in one call."""

import random

import pytest

from genomill.operators.exact import suffix_order, unique_matches
from genomill.operators.frontier import recursive_matches
from genomill.operators.maximal import recursive_anchors


def sets(n_sets, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n_sets):
        n, base = rng.choice([1, 2, 2, 3, 4]), [rng.choice("ACGT") for _ in range(rng.choice([0, 4, 60, 200, 400]))]
        if base and rng.random() < 0.5:
            base[-40:] = base[:40]  # a repeat
        for place in range(n):
            s = [c if rng.random() > 0.06 else rng.choice(["A", "CC", "", "G", "N"]) for c in base]
            if rng.random() < 0.4 and len(s) > 80:
                cut = rng.randrange(len(s))
                s = s[cut:] + s[:cut]
            rows.append((i, place, "".join(s)))
    return rows


@pytest.mark.parametrize("factor, shortest", [(1.1, 5), (0.6, 3), (1.1, 30)])
def test_frontier_is_the_search_in_one_call(spark, factor, shortest):
    rows = sets(60)
    found = recursive_matches(spark.createDataFrame(rows, "set_id long, place int, seq string"), factor, shortest)
    got = {}
    for r in found.collect():
        got.setdefault(r.set_id, []).append((tuple(r.starts), r.length, r.generation))
    by_set = {}
    for i, _, s in rows:
        by_set.setdefault(i, []).append(s)
    expected = {i: a for i, seqs in by_set.items() if len(seqs) > 1 and (a := recursive_anchors(seqs, factor, shortest))}
    assert {i: sorted(v) for i, v in got.items()} == expected
    assert max(g for v in got.values() for _, _, g in v) > 2 or shortest == 30


def test_generations_can_be_limited_and_nothing_gives_nothing(spark):
    g = spark.createDataFrame(sets(20), "set_id long, place int, seq string")
    all_of_it = {(r.set_id, tuple(r.starts), r.length) for r in recursive_matches(g, 0.6, 3).where("generation <= 2").collect()}
    assert {(r.set_id, tuple(r.starts), r.length) for r in recursive_matches(g, 0.6, 3, generations=2).collect()} == all_of_it
    assert recursive_matches(g.limit(0)).count() == 0


def test_suffix_order_with_breaks():
    import numpy as np

    rng = random.Random(3)
    for t in range(150):
        text = [rng.choice([-1, 0, 0, 1, 3] if t % 2 else [-1] + [0] * 40 + [1]) for _ in range(rng.randint(0, 150))] + [-1]
        marks = iter(range(len(text)))
        unlike = [x if x >= 0 else -1000 + next(marks) for x in text]
        order, common = suffix_order(np.array(text, np.int8))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: unlike[i:])
        for a, b, n in zip(order, order[1:], common):
            assert unlike[a : a + n] == unlike[b : b + n] and (unlike[a + n :] or [None])[0] != (unlike[b + n :] or [-1])[0]


def test_long_alike_genomes():
    rng = random.Random(4)
    a = [rng.choice("ACGT") for _ in range(60_000)]
    b = list(a)
    at = sorted(rng.sample(range(60_000), 40))
    for i in at:
        b[i] = "ACGT"[("ACGT".index(b[i]) + 1) % 4]
    a, b = "".join(a), "".join(b)
    got = unique_matches([a, b], 20)
    edges = [0, *(i + 1 for i in at)]
    assert {(s, s) for (s, _), n in got} >= {(x, x) for x, y in zip(edges, [*at, 60_000], strict=True) if y - x > 40}
    assert all(a[i : i + n] == b[j : j + n] for (i, j), n in got)
