"""Kernels against plain definitions, and against cases worked out by hand."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from genomill.functions import sequence as S
from genomill.operators import intervals as I
from genomill.operators.columns import GAP_OPEN, pair_score
from genomill.operators.distances import kmer_distances
from genomill.operators.dp import PartialOrder, Profile, align_pair, global_path, local_score
from genomill.operators.matches import compatible, multi_matches, pair_matches, unique_matches
from genomill.operators.maximal import recursive_anchors
from genomill.operators.recruit import fast_cut
from genomill.operators.trees import kmer_distance_matrix, leaf_weights, midpoint, multiple_alignment, neighbour_joining, upgma
from genomill.sources import formats as R

BASES = st.text("ACGT", min_size=1, max_size=7)


def gap_cost(start, length, n, open_=GAP_OPEN / 2):
    return (0.0 if start == 0 else open_) + (0.0 if start + length == n else open_)


def path_score(a, b, path):
    total, i, j, k = 0.0, 0, 0, 0
    while k < len(path):
        run = k
        while run < len(path) and path[run] == path[k]:
            run += 1
        n = run - k
        if path[k] == "M":
            total += sum(pair_score(a[i + t], b[j + t]) for t in range(n))
            i, j = i + n, j + n
        elif path[k] == "D":
            total += gap_cost(i, n, len(a))
            i += n
        else:
            total += gap_cost(j, n, len(b))
            j += n
        k = run
    return total


def all_paths(n, m):
    def walk(i, j, last):
        if i == n and j == m:
            yield ""
        if i < n and j < m:
            yield from ("M" + p for p in walk(i + 1, j + 1, "M"))
        if i < n and last != "I":
            yield from ("D" + p for p in walk(i + 1, j, "D"))
        if j < m and last != "D":
            yield from ("I" + p for p in walk(i, j + 1, "I"))

    return walk(0, 0, "M")


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=5), st.text("ACGT", min_size=1, max_size=5))
def test_global_alignment_is_optimal(a, b):
    one = np.ones(1)
    path = global_path(Profile([a], one), Profile([b], one))
    assert path_score(a, b, path) == pytest.approx(max(path_score(a, b, p) for p in all_paths(len(a), len(b))))


@settings(max_examples=60, deadline=None)
@given(BASES, BASES)
def test_pairs_degap_to_their_inputs(a, b):
    x, y = align_pair(a, b)
    assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b


@settings(max_examples=60, deadline=None)
@given(BASES, BASES)
def test_local_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i, j in product(range(len(a)), range(len(b))):
        h[i + 1, j + 1] = max(0, h[i, j] + pair_score(a[i], b[j]), h[i, j + 1] - 200, h[i + 1, j] - 200)
    assert local_score(a, b)[0] == pytest.approx(h.max())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ACGTN", max_size=30), min_size=1, max_size=6))
def test_multiple_alignment_keeps_its_sequences(seqs):
    rows = multiple_alignment(seqs)
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs


@settings(max_examples=40, deadline=None)
@given(st.lists(BASES, min_size=1, max_size=5))
def test_partial_order_keeps_its_sequences(seqs):
    graph = PartialOrder()
    for s in seqs:
        graph.add(s)
    rows = graph.rows()
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == seqs


def test_partial_order_of_equal_sequences_has_no_gaps():
    graph = PartialOrder()
    for s in ("ACGTACGT", "ACGTACGT", "ACGACGT"):
        graph.add(s)
    assert graph.rows()[:2] == ["ACGTACGT"] * 2 and len(graph.rows()[2]) == 8


def test_upgma_by_hand():
    d = np.full((5, 5), 14.0)
    d[4, :] = d[:, 4] = 20.0
    d[0, 1] = d[1, 0] = 2.0
    d[2, 3] = d[3, 2] = 4.0
    assert upgma(d, "avg").height[5:] == [1.0, 2.0, 7.0, 10.0]


def test_kmer_distance_by_hand():
    assert kmer_distance_matrix(["AAAAAAAA", "AAAAAAAT"])[0, 1] == 1.0


def test_neighbour_joining_recovers_an_additive_tree():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    edges = neighbour_joining(d)
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def between(a, b, seen=()):
        return 0.0 if a == b else next((w + r for c, w in near[a] if c not in seen and (r := between(c, b, (*seen, a))) is not None), None)

    assert all(between(a, b) == pytest.approx(d[a, b]) for a in range(5) for b in range(5))
    u, v, at = midpoint(edges, 5)
    assert at >= 0 and (u, v) != (v, u)


def test_weights_add_up_and_two_leaves_are_even():
    assert leaf_weights(upgma(np.array([[0.0, 3.0], [3.0, 0.0]]))).tolist() == [0.5, 0.5]
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    assert leaf_weights(upgma(kmer_distance_matrix(seqs))).sum() == pytest.approx(1)


def naive_matches(seqs, least):
    """From the definition: substrings that occur once in each sequence and can't be extended in all of them."""
    out = set()
    for i in range(len(seqs[0])):
        for j in range(i + least, len(seqs[0]) + 1):
            word = seqs[0][i:j]
            places = [[p for p in range(len(s) - len(word) + 1) if s.startswith(word, p)] for s in seqs]
            if "N" in word or any(len(p) != 1 for p in places):
                continue
            at = [p[0] for p in places]
            left = {s[p - 1] if p else f"begin {k}" for k, (s, p) in enumerate(zip(seqs, at, strict=True))}
            right = {s[p + len(word)] if p + len(word) < len(s) else f"end {k}" for k, (s, p) in enumerate(zip(seqs, at, strict=True))}
            if all(len(x) > 1 or x == {"N"} for x in (left, right)):
                out.add((tuple(at), len(word)))
    return sorted(out)


def related(rng, n, alphabet):
    base = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
    out = []
    for _ in range(n):
        a, b = sorted((rng.randint(0, len(base)), rng.randint(0, len(base))))
        out.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) + base[a:b] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) + base[b:])
    return out


def test_unique_matches_against_all_substrings():
    rng = random.Random(7)
    for _ in range(300):
        seqs, least = related(rng, rng.choice([2, 2, 3, 4]), rng.choice(["AC", "ACGT", "ACGTN", "A"])), rng.randint(1, 5)
        assert unique_matches(seqs, least) == naive_matches(seqs, least), (seqs, least)
    assert unique_matches(["ACGTTGCAGGTCA", "ACGTTGCAGGTCA"], 4) == [((0, 0), 13)]
    assert all(n < 8 for _, n in unique_matches(["AACCGGTT", "AACCGTAGACCGGTT"], 5))


def test_pairs_and_sets_of_matches(spark):
    rng = random.Random(8)
    flip = str.maketrans("ACGT", "TGCA")
    sets = [related(rng, 3, "ACG") for _ in range(12)]
    rows = [(k, 3 * k + i, x) for k, own in enumerate(sets) for i, x in enumerate(own)]
    s = spark.createDataFrame(rows, "set_id long, seq_id long, seq string")
    got = multi_matches(s, 3).collect()
    assert sorted((r.set_id, tuple(r.starts), r.length) for r in got) == sorted((k, *m) for k, own in enumerate(sets) for m in naive_matches(own, 3))
    pairs = spark.createDataFrame([(3 * k, own[0], 3 * k + 1, own[1]) for k, own in enumerate(sets)], "ref_id long, ref_seq string, query_id long, seq string")
    want = [(3 * k, 3 * k + 1, fwd, *at, n) for k, own in enumerate(sets) for fwd, q in ((True, own[1]), (False, own[1].translate(flip)[::-1])) for at, n in naive_matches([own[0], q], 3)]
    assert sorted(tuple(r) for r in pair_matches(pairs, 3).collect()) == sorted(want)


def test_anchors_are_disjoint_equal_and_leave_no_region():
    rng = random.Random(9)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACGT") for _ in range(80)) for _ in range(2))
        seqs = [a + b, b[:50] + a + b[50:], a[:30] + "T" + a[30:] + b]  # also matches in another order
        anchors = recursive_anchors(seqs)
        for k, s in enumerate(seqs):
            held = sorted((p[k], p[k] + n) for p, n, _ in anchors)
            assert all(x[1] <= y[0] for x, y in zip(held, held[1:], strict=False)) and all(seqs[0][p[0] : p[0] + n] == s[p[k] : p[k] + n] for p, n, _ in anchors)
        whole = {m for m in unique_matches(seqs, 9)}
        assert sum(n for _, n, g in anchors if g == 1) <= sum(n for _, n in whole) and len(anchors) >= 2
        assert any(x[0][0] < y[0][0] and x[0][1] > y[0][1] for x in anchors for y in anchors)


def test_compatible_diagonals_one_by_one(spark):
    rng = random.Random(10)
    rows, want = [], set()
    for g in range(40):
        d = sorted((rng.randint(0, 60), rng.randint(0, 60), rng.choice([1, 3, 5, 25])) for _ in range(rng.randint(0, 9)))
        overlap = lambda x, y, k: min(x[k] + x[2], y[k] + y[2]) > max(x[k], y[k])
        agree = lambda x, y: x[0] - x[1] == y[0] - y[1] and overlap(x, y, 0) or not overlap(x, y, 0) and not overlap(x, y, 1)
        gone = set()
        for i, x in enumerate(d):
            for j in range(i + 1, len(d)):
                if not agree(x, d[j]):
                    gone |= {j} if x[2] > 4 * d[j][2] else {i} if d[j][2] > 4 * x[2] else {i, j}
        for i, x in enumerate(d):
            if i not in gone:
                for j in range(i + 1, len(d)):
                    if j not in gone and x[1] >= d[j][1]:
                        gone |= {i, j}
        rows += [(g, i, *x) for i, x in enumerate(d)]
        want |= {(g, i) for i in range(len(d)) if i not in gone}
    got = compatible(spark.createDataFrame(rows, "grp long, i long, a long, b long, len long"), "grp", bin_size=8).collect()
    assert {(r.grp, r.i) for r in got} == want and len(got) == len(want)


def test_kmer_distances_of_sets_of_any_size(spark):
    rng = random.Random(12)
    rows = [(0, i, "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 30)))) for i in range(11)] + [(1, 20, "ACGT")]
    got = {(r.a, r.b): r.d for r in kmer_distances(spark.createDataFrame(rows, "set_id long, seq_id long, seq string"), 3, block=4).collect()}
    count = lambda s: Counter(s[i : i + 3] for i in range(len(s) - 2))
    want = {}
    for _, a, x in rows[:11]:
        for _, b, y in rows[:11]:
            if b < a:
                n, least = sum((count(x) & count(y)).values()), min(max(len(x) - 2, 0), max(len(y) - 2, 0))
                want[a, b] = 3.0 * (least - n) / least if least else 1.0
    assert got == pytest.approx(want)


def test_fast_cut_keeps_all_near_rows(spark):
    rng = random.Random(3)
    groups = {"copies": [0.1] * 300 + [0.4], "spread": [rng.uniform(0.2, 0.6) for _ in range(400)], None: [0.3] * 150, "few": [0.1, 0.2, 0.7]}
    rows = [(g, i, d) for g, own in groups.items() for i, d in enumerate(own)]
    want = set()
    for g, own in groups.items():
        low = sorted(d for d in own if d < 0.5)[:101]
        want |= {(g, i) for i, d in enumerate(own) if d < 0.5 and d <= min(low) + 3 * np.std(low) + 1e-12}
    got = fast_cut(spark.createDataFrame(rows, "lang string, seq_id long, d double"), "lang").collect()
    assert len(got) == len(want) and {(r.lang, r.seq_id) for r in got} == want


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_expressions_by_hand(spark):
    r = one(spark, rc=S.reverse_complement(F.lit("AACGTN")), near=S.kimura(F.lit(0.9)), half=S.kimura(F.lit(0.5)), table=S.kimura(F.lit(0.2)), far=S.kimura(F.lit(0.05)), least=S.formula("1.1*(Log(S))", F.lit(30111)), power=S.formula("2^3^0.5 - 4/2", F.lit(1)))
    assert r.rc == "NACGTT" and r.near == pytest.approx(0.107585, abs=1e-6) and r.half == pytest.approx(0.798508, abs=1e-6)
    assert (r.table, r.far, r.least, r.power) == (2.46, 10.0, 17, 2)
    for bad in ("S;drop", "1 +* 2", "(S", "2 2"):
        with pytest.raises((ValueError, IndexError)):
            S.formula(bad, F.lit(1))


def ivs(spark, rows):
    return spark.createDataFrame(rows, "k string, start long, end long")


def rows(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_intervals_by_hand(spark):
    a, b = ivs(spark, [("x", 0, 10), ("x", 20, 30)]), ivs(spark, [("x", 5, 25)])
    assert rows(I.intersect(a, b, ["k"], 4)) == [(5, 10), (20, 25)]
    assert rows(I.intersect(ivs(spark, [("x", 0, 10)]), ivs(spark, [("x", 10, 20)]), ["k"])) == []
    assert rows(I.cut_overlaps(ivs(spark, [("x", 0, 10), ("x", 5, 12), ("x", 11, 20)]), ["k"])) == [(0, 10), (11, 12), (13, 20)]
    sizes = lambda *own: spark.createDataFrame(own, "k string, size long")
    assert rows(I.complement(a, ["k"], sizes(("x", 33)))) == [(10, 20), (30, 33)]
    assert rows(I.complement(b, ["k"], sizes(("x", 26), ("y", 7)))) == [(0, 5), (0, 7)]  # a run of one place is none
    assert rows(I.disjoint(ivs(spark, [("x", 0, 10), ("x", 2, 8), ("x", 5, 20)]), ["k"])) == [(0, 10), (11, 20)]


@pytest.mark.parametrize("bin_size", [3, 16, 1000])
def test_islands_against_sets(spark, bin_size):
    rng = random.Random(5)
    own = {k: [(s, s + rng.choice([1, 2, 5, 40])) for s in (rng.randint(0, 300) for _ in range(25))] for k in ("x", "y", None)}
    got = I.merged(ivs(spark, [(k, *i) for k, x in own.items() for i in x]), ["k"], bin_size).collect()
    for k, x in own.items():
        held = {p for a, b in x for p in range(a, b)}
        starts, ends = sorted(p for p in held if p - 1 not in held), sorted(p + 1 for p in held if p + 1 not in held)
        assert sorted((r.start, r.end) for r in got if r.k == k) == list(zip(starts, ends, strict=True))


def test_intersections_against_sets(spark):
    rng = random.Random(3)
    make = lambda: [("x", s, s + rng.randint(1, 30)) for s in rng.sample(range(400), 20)]
    lists = [make() for _ in range(3)]
    cover = [{p for _, s, e in x for p in range(s, e)} for x in lists]
    all_ = spark.createDataFrame([(i, *r) for i, x in enumerate(lists) for r in x], "chunk int, k string, start long, end long")
    got = {p for s, e in rows(I.intersect_all(all_, "chunk", ["k"], 3)) for p in range(s, e)}
    assert got == cover[0] & cover[1] & cover[2]


def test_newick_and_fasta_parsers(spark):
    assert R.newick_nodes("(a:1,(b:2,'c d':3)x:4)r;") == [(0, None, "r", None), (1, 0, "a", 1.0), (2, 0, "x", 4.0), (3, 2, "b", 2.0), (4, 2, "c d", 3.0)]
    df = spark.createDataFrame([(">a one\nAC\nGT\n\n>b\nNN",)], "value string")
    assert [tuple(r) for r in R.fasta_records(df).collect()] == [(1, "a", "one", "ACGT"), (2, "b", "", "NN")]
