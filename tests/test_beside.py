"""Kernels that compute many small problems at once give what each gives alone."""

import random

import numpy as np
import pytest

from genomill.operators import dp as D
from genomill.operators.objectives import score_pair, scores_beside
from genomill.operators.refine import groups_of, refine, refining, tree_of
from genomill.operators.trees import aligning, multiple_alignment


def plain_path(a, b):
    """Cell by cell, in double precision; on ties M before D before I."""
    n, m, score = len(a.shares), len(b.shares), a.shares @ D.SCORES @ b.shares.T
    best, back = {(0, 0, 0): 0.0}, {}
    low = lambda i, j, s: best.get((i, j, s), -1e18)
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                x = [low(i - 1, j - 1, 0), low(i - 1, j - 1, 1) + (a.close[i - 2] if i > 1 else 0), low(i - 1, j - 1, 2) + (b.close[j - 2] if j > 1 else 0)]
                back[i, j, 0], best[i, j, 0] = int(np.argmax(x)), score[i - 1, j - 1] + max(x)
            if i:
                x = [low(i - 1, j, 0) + a.open[i - 1], low(i - 1, j, 1)]
                back[i, j, 1], best[i, j, 1] = int(np.argmax(x)), max(x)
            if j:
                x = [low(i, j - 1, 0) + b.open[j - 1], low(i, j - 1, 2)]
                back[i, j, 2], best[i, j, 2] = 2 * int(np.argmax(x)), max(x)
    state, i, j, out = int(np.argmax([low(n, m, s) for s in range(3)])), n, m, ""
    while i or j:
        out, before = "MDI"[state] + out, back[i, j, state]
        i, j, state = i - (state < 2), j - (state != 1), before
    return out


def alignments(rng, n):
    def rows():
        base = [rng.choice("ACGT") for _ in range(rng.choice([1, 2, 9, 30]))]
        return ["".join(c if rng.random() > 0.2 else rng.choice("ACGT-") for c in base) for _ in range(rng.choice([1, 1, 2]))]  # shares that floats of 32 bits hold

    return [(x, np.full(len(x), 0.25)) for x in (rows() for _ in range(n))]


def asked(one, two):
    return (yield one, two)


def test_paths_side_by_side_are_those_of_single_cells():
    rng = random.Random(1)
    pairs = list(zip(alignments(rng, 150), alignments(rng, 150), strict=True))
    expected = [plain_path(D.Profile(*one), D.Profile(*two)) for one, two in pairs]
    assert [path for _, path in sorted(D.together((50, asked(*p)) for p in pairs))] == expected
    assert [path for _, path in sorted(D.together(((50, asked(*p)) for p in pairs), most=120))] == expected
    assert [D.global_path(D.Profile(*one), D.Profile(*two)) for one, two in pairs] == expected


def test_works_share_their_calls(monkeypatch):
    rng, calls, own = random.Random(2), [], D._side_by_side
    monkeypatch.setattr(D, "_side_by_side", lambda pairs: calls.append(len(pairs)) or own(pairs))
    sets = [["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(4)] for _ in range(60)]
    starts = [multiple_alignment(s) for s in sets]
    calls.clear()
    assert [r for _, r in sorted(D.together((160, aligning(s)) for s in sets))] == starts
    assert sum(calls) == 3 * len(sets) and len(calls) < 20
    alone = [refine(s, *tree_of(s)) for s in starts]
    calls.clear()
    assert [r for _, r in sorted(D.together((160, refining(s, *tree_of(s))) for s in starts))] == alone
    assert len(calls) * 5 < sum(calls)


def test_a_row_beside_others_scores_as_each_pair():
    rng = random.Random(3)
    for _ in range(500):
        n = rng.randint(0, 12)
        rows = ["".join(rng.choice("AC--N.") for _ in range(n)) for _ in range(5)]
        codes = D.letters(rows)
        assert scores_beside(codes[0], codes[1:]) == pytest.approx([sum(score_pair(rows[0], r)) for r in rows[1:]]), rows


def test_groups_go_on_behind_a_batch():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in ([1, 1, 2], [2], [2, 3], [], [4, 4])]
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64())])
    assert [g.column("v").to_pylist() for g in groups_of((b.cast(schema) for b in batches), ["k"])] == [[1, 1], [2, 2, 2], [3], [4, 4]]
    assert list(groups_of(iter([]), ["k"])) == []


def test_edges_of_many_paths_are_made_in_parts(spark):
    import pyarrow as pa

    from genomill.sources import formats

    rng = random.Random(4)
    paths = ["".join(rng.choices("MDI", k=rng.choice([0, 1, 700, 900]))) for _ in range(4000)] + [None]
    rows = spark.createDataFrame(list(enumerate(paths)), "i long, p string").coalesce(1)
    got = {r.i: r.edges for r in formats.edges_of(rows, "p", "i").collect()}
    assert got[4000] is None and len(got) == 4001
    for i in range(0, 4000, 50):
        assert [tuple(e) for e in got[i]] == [(c, sum(x in "MD" for x in paths[i][: k + 1]), sum(x in "MI" for x in paths[i][: k + 1])) for k, c in enumerate(paths[i])]
    table = pa.RecordBatch.from_pydict({"i": list(range(4001)), "p": paths})
    sent = [len(pa.concat_arrays([b.column("edges")]).flatten()) for b in formats.edge_batches(iter([table]), "p", ["i"])]
    assert sum(sent) == sum(len(p or "") for p in paths) and max(sent) <= formats.SENT < sum(sent)


def test_gaps_of_a_batch_share_their_calls(monkeypatch):
    import pyarrow as pa

    from genomill.operators.blocks import _aligning
    from genomill.operators.extension import align_gap

    rng, calls, own = random.Random(7), [], D._side_by_side
    monkeypatch.setattr(D, "_side_by_side", lambda pairs: calls.append(len(pairs)) or own(pairs))
    pieces = [["".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 20, 30]))) for _ in range(3)] for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"set_id": list(range(600)), "starts": [[0] * 3] * 600, "ends": [[1] * 3] * 600, "pieces": [[s.encode() for s in p] for p in pieces]})
    got = {r["set_id"]: r["rows"] for b in _aligning(iter([batch])) for r in b.to_pylist()}
    assert len(calls) * 20 < sum(calls)
    assert got == {i: align_gap(p) for i, p in enumerate(pieces)}


def test_regions_searched_in_one_give_their_own_matches():
    from genomill.operators import exact as X

    rng = random.Random(5)
    for n, k, alphabet in ((2, 3, "ACGT"), (3, 4, "ACN"), (2, 5, "A"), (4, 3, "AC"), (2, 28, "ACGT"), (2, 40, "ACGT")):
        regions = []
        for _ in range(120):
            base = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 2, 5, 40, 90])))
            regions.append(["".join(c if rng.random() > 0.05 else rng.choice(alphabet) for c in base) + base[: rng.choice([0, 9])] for _ in range(n)])
        sizes = np.array([[len(s) for s in r] for r in regions])
        starts = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        data = X.codes_of("".join(s for r in regions for s in r))
        got = [[] for _ in regions]
        for lot in X.regions_beside(sizes.sum(axis=1), k):
            for i, at, length in zip(*(x.tolist() for x in X.matches_beside(data, starts[lot], sizes[lot], k)), strict=True):
                got[lot[i]].append((tuple(at), length))
        assert got == [X.unique_matches(r, k) for r in regions], (n, k)
        assert n == 4 or alphabet == "A" or k > 20 or any(got)


def test_regions_of_a_batch_share_their_calls(spark, monkeypatch):
    import pyarrow as pa

    from genomill.operators import frontier as R
    from genomill.operators.exact import unique_matches

    rng, calls, own = random.Random(6), [], R.matches_beside
    monkeypatch.setattr(R, "matches_beside", lambda *x: calls.append(1) or own(*x))
    pieces = [["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2)] for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"set_id": list(range(500)), "starts": [[7, 9]] * 500, "ends": [[67, 69]] * 500, "least": [4] * 500, "pieces": [[s.encode() for s in p] for p in pieces]})
    got = {r["set_id"]: r for b in R._matching(2)(iter([batch.slice(0, 3), batch.slice(3)])) for r in b.to_pylist()}
    assert len(calls) == 2
    for i, p in enumerate(pieces):
        raw = [{"starts": [7 + a, 9 + b], "length": n} for (a, b), n in unique_matches(p, 4)]
        assert (got[i]["raw"], got[i]["own"]) == (raw, R._kept(raw, [], [7, 9], [67, 69], 2)) if raw else i not in got
