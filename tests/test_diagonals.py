"""Diagonals and regions against the rule, symbol by symbol."""

import random

import pytest

from genomill.operators.diagonals import diagonals, find_diagonals, regions


def naive(x, y, k, shortest):
    if min(len(x), len(y)) < k + 16:
        return []
    swap = len(x) >= len(y)
    a, b = (y, x) if swap else (x, y)
    place = {}
    for i in range(len(b) - k):
        if "N" not in b[i : i + k]:
            place[b[i : i + k]] = i
    out, i = [], 0
    while i < len(a) - k:
        if a[i : i + k] in place:
            j, n = place[a[i : i + k]], k
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != "N":
                n += 1
            if n >= shortest:
                out.append((j, i, n) if swap else (i, j, n))
            i += n
        else:
            i += 1
    return out


@pytest.mark.parametrize("k, shortest, letters", [(3, 5, "ACGT"), (2, 3, "AC"), (7, 24, "ACGT"), (3, 4, "ACGTN")])
def test_diagonals_by_the_rule(k, shortest, letters):
    rng = random.Random(k)
    for _ in range(300):
        x = [rng.choice(letters) for _ in range(rng.randint(0, 150))]
        y = [c if rng.random() > 0.03 else rng.choice(["", "A", "CG"]) for c in x]
        if len(y) > 60 and rng.random() < 0.5:
            y = y[30:] + y[:50]
        x, y = "".join(x), "".join(y)
        assert find_diagonals(x, y, k, shortest) == naive(x, y, k, shortest)
        assert find_diagonals(y, x, k, shortest) == naive(y, x, k, shortest)


def test_regions_cover_both_sequences(spark):
    rng = random.Random(5)
    x = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(0, x, 1, x), (0, x, 2, x[:150] + "T" * 9 + x[190:]), (0, x, 3, "".join(rng.choice("ACGT") for _ in range(90))), (0, x, 4, ""), (0, x, 5, x[200:] + x[:200])]
    pairs = spark.createDataFrame(rows, "ref_id long, ref_seq string, query_id long, seq string")
    sizes = pairs.selectExpr("query_id", "cast(length(ref_seq) as bigint) a_size", "cast(length(seq) as bigint) b_size")
    d = diagonals(pairs)
    kept = d.where("query_id <> 5 or i = 0")
    got = {}
    for r in regions(kept, sizes, "query_id").orderBy("query_id", "nth").collect():
        got.setdefault(r.query_id, []).append(r)
    for _, a, q, b in rows:
        at, to = 0, 0
        for r in got[q]:
            assert (r.a, r.b) == (at, to) and r.a_len >= 0 and r.b_len >= 0
            assert r.kind == "rect" or a[r.a : r.a + r.a_len] == b[r.b : r.b + r.b_len]
            at, to = at + r.a_len, to + r.b_len
        assert (at, to) == (len(a), len(b))
    assert [r.kind for r in got[1]] == ["rect", "diag", "rect"] and len(got[2]) == 5 and len(got[3]) == len(got[4]) == 1
    assert diagonals(pairs.limit(0)).count() == 0
