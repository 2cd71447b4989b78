"""Filter audit, nearest vectors and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from genomill.llm import filter_audit, neighbours, queries, spelling

DOCS = "doc_id long, text string, lang string, source string"


# 11


def naive_mask(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t))]


def odd_texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcAB#éß日😀") for _ in range(rng.choice([1, 2, 5, 8, 9, 16, 17, 70]))) for _ in range(150)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\t", "\n", "  ", "\x0b", "\r\n", " "]) for _ in range(rng.choice([0, 1, 5, 99, 100, 150, 400]))) for _ in range(n)]
    return [*texts, None, "", " ", "A" * 5000, "x" * 64 + " " + "x" * 65 + " " + "x" * 65, "\x00 \x00", "é" * 8 + " " + "é" * 8]


def test_transducer_counts_like_patterns():
    texts = [t or "" for t in odd_texts(1, 200)]
    got = filter_audit.text_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        naive = {"words": len(words), "distinct": len(set(words)), "capitals": len(re.findall("[A-Z]", t)), "points": len(t), "symbols": len(re.findall(r"[#$%&*|]", t))}
        assert {k: int(v[i]) for k, v in got.items()} == naive, t[:50]
    assert all(len(v) == 0 for v in filter_audit.text_counts([]).values())


def test_equal_hashes_of_words_are_verified(monkeypatch):
    monkeypatch.setattr(filter_audit.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert filter_audit.text_counts([b"a b a c", b"a a"])["distinct"].tolist() == [3, 1]


def naive_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = [(lang or "", [*naive_mask(t), i is not None and i > first[t or ""]], i in good, i in bad) for i, t, lang, _ in rows]
    out = []
    for part in {d[0] for d in docs}:
        own, found = [d for d in docs if d[0] == part], []
        for order in permutations("ABCDE"):
            before = []
            for step, f in enumerate(order):
                k = "ABCDE".index(f)
                left = [d for d in own if not any(d[1][b] for b in before)]
                gone = [d for d in left if d[1][k]]
                found.append(("".join(order), step + 1, f, len(left) - len(gone), len(gone), sum(d[1][k] for d in own) - len(gone), sum(d[1][k] and sum(d[1]) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
                before.append(k)
        shapley = Counter()
        for r in found:
            shapley[r[2]] += r[4]
        out += [(part, *r, shapley[r[2]]) for r in found]
    return sorted(out)


def test_filter_audit(spark):
    rng, texts = random.Random(2), odd_texts(3, 40)
    rows = [(i, t, rng.choice(["en", "fr", "", None]), None) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7], "en", None) for i in range(30)] + [rows[3], (rows[4][0], texts[0], "fr", None), (None, texts[0], "fr", None), (None, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("mask", "part", "sha", "n", "quality", "own", "first")})
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = filter_audit.filter_audit(docs, table)
    assert sorted(tuple(r) for r in got.collect()) == naive_audit(rows, labels)
    assert filter_audit.filter_audit(docs.limit(0), table).count() == 0
    assert filter_audit.filter_audit(docs, table.limit(0)).agg(F.sum("good_lost"), F.count("*")).first()[:] == (0, 600 * 3)


def test_filter_audit_query_is_its_sql(spark, duck):
    same_rows(queries.op11_filter_audit(spark, DATA), duck, queries.oracle_sql()["op11_filter_audit"])


# 12


def naive_nearest(rows, k=20, every=20):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    width = max((len(v) for _, v in fine), default=0)
    fine = [(i, np.append(v, np.zeros(width - len(v)))) for i, v in fine]
    out = {}
    for i, q in fine:
        if i % every == 0:
            out[i] = sorted((-float(q @ v), j) for j, v in fine if j != i)[:k]
    return out


def held_against(found, naive, least=0.9, k=20):
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {i for i, v in naive.items() if v}
    hits = total = 0
    for i, best in naive.items():
        own = got.get(i, [])
        assert len(own) == len(best)
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))
        truth = dict((j, -s) for s, j in best)
        assert all(abs(s - truth[j]) < 1e-9 * max(1, abs(s)) for j, s in own if j in truth)
        hits += len({j for j, _ in own} & set(truth))
        total += len(best)
    assert hits >= least * total, hits / total
    return hits / max(total, 1)


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("rows, asked", [(8192, 4096), (60, 7)])
def test_nearest_on_odd_vectors(spark, monkeypatch, rows, asked):
    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "ASKED", asked)
    rng = np.random.default_rng(4)
    data = [(i, (rng.standard_normal(16) * rng.choice([0.1, 1, 5])).tolist()) for i in range(600)]
    data[40] = (40, [9.0, *data[40][1][1:]])
    data += [(1000 + i, data[40][1]) for i in range(200)]  # one common vector
    data += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [1.0, None]), (2080, [float("nan"), 1.0]), (2100, [float("inf")] * 16), (2120, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "x", "block", "least", "of", "salt", "score")})
    naive = naive_nearest(data)
    held_against(collected(neighbours.nearest(df)), naive)
    # equal vectors: the smallest ids
    got = [r["vec_id"] for r in sorted(collected(neighbours.nearest(df)), key=lambda r: r["rank"]) if r["query_id"] == 40 and r["vec_id"] >= 1000]
    assert got == sorted(got) and got[:3] == [1000, 1001, 1002]


def test_nearest_of_few_rows(spark):
    few = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(neighbours.nearest(df)))
    assert got == [(0, 1, 20, 4.0), (0, 2, 3, 1.5), (0, 3, 3, 1.5), (20, 1, 0, 4.0), (20, 2, 3, 1.5), (20, 3, 3, 1.5)]
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0
    huge = spark.createDataFrame([(0, [1e300, -1e300]), (1, [1e300, 1e-300]), (2, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(huge).count() == 2


def asked_of(space, ids, x, k, least=-np.inf):
    return neighbours.Asked(space, k, ids, x, np.full(len(ids), least), np.full(len(ids), -1))


def space_of(x):
    largest = np.abs(x).max()
    return neighbours.Space(x.shape[1], largest, np.linalg.norm(x / largest, axis=1).max())


@pytest.mark.parametrize("scale", [1.0, 1e-200, 1e150])
@pytest.mark.parametrize("tile, checked", [(1 << 20, 1 << 16), (300, 16)])
def test_block_finds_what_the_definition_does(monkeypatch, scale, tile, checked):
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "CHECKED", checked)
    rng, k = np.random.default_rng(6), 20
    x = rng.standard_normal((900, 16)) * scale
    x[300:500], x[500:520] = x[20], x[40]  # copies of other ids
    ids = np.arange(900)
    ids[500:520] = 40  # and rows that are one and the same
    space, queries_ = space_of(x), np.unique(ids[ids % 20 == 0], return_index=True)
    asked = asked_of(space, queries_[0], x[queries_[1]], k)
    mixed = rng.permutation(900)
    neighbours.Block(space, 0, ids[mixed], x[mixed], k).search(asked, 1e9)
    for i, q, got, scores in zip(asked.ids, asked.x, *(v.to_pylist() for v in asked.lists()), strict=True):
        score = np.einsum("ij,ij->i", x, np.repeat(q[None], 900, axis=0))
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        assert got == ids[best].tolist() and scores == score[best].tolist()


def test_copies_and_far_rows_are_not_verified_one_by_one(monkeypatch):
    rng, k, seen = np.random.default_rng(7), 20, []
    add = neighbours.Asked.add
    monkeypatch.setattr(neighbours.Asked, "add", lambda self, q, *rest: (seen.append(len(q)), add(self, q, *rest))[1])
    for n in (2_000, 8_000):
        x = rng.standard_normal((n, 64))
        x[n // 2 :] = x[0]  # half of the rows are one vector
        x /= np.linalg.norm(x, axis=1)[:, None]
        space, ids = space_of(x), np.arange(n)
        asked = asked_of(space, ids[:50], x[:50], k)
        block = neighbours.Block(space, 0, ids, x, k)
        assert len(block.ids) == n // 2 - 1 + 2 * k
        seen.append([])
        block.search(asked, neighbours.quantile(neighbours.CONFIDENCE, neighbours.DIMENSIONS))
    at = seen.index([])
    few, many = (sum(v for v in part if v) for part in (seen[at + 1 : seen.index([], at + 1)], seen[seen.index([], at + 1) + 1 :]))
    assert many < 2 * few  # of four times the rows; before, two thirds of the rows were verified


def test_visits_of_a_query_do_not_grow_with_the_table(spark, monkeypatch):
    for name, value in (("FEW", 50), ("BLOCKS", 8), ("GROUPS", 3), ("ASKED", 7)):
        monkeypatch.setattr(neighbours, name, value)
    visits, searched = [], neighbours.searched
    monkeypatch.setattr(neighbours, "searched", lambda dealt, asks, *rest: (visits.append(asks.count()), searched(dealt, asks, *rest))[1])
    rng = np.random.default_rng(8)
    for n in (500, 3_000):
        data = [(i, v) for i, v in enumerate(rng.standard_normal((n, 24)).astype(np.float32).tolist())]
        df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
        assert held_against(collected(neighbours.nearest(df)), naive_nearest(data)) > 0.97
    assert visits[0] == 25 and visits[2] == 150 and visits[1] <= 3 * 25 and visits[3] <= 3 * 150


def test_chi_square():
    assert abs(neighbours.chi_square(2 * np.log(2), 2) - 0.5) < 1e-12
    assert abs(neighbours.quantile(0.95, 8) - 15.5073) < 1e-3
    rng = np.random.default_rng(1)
    assert abs((rng.chisquare(12, 200_000) <= neighbours.quantile(0.9, 12)).mean() - 0.9) < 0.01


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_tables(spark, sf):
    where = f"/root/testdata/{sf}"
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    held_against(collected(queries.op12_nearest(spark, where)), naive_nearest(data))


# 13


def naive_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{w}".encode())) % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def naive_variants(n):
    near = {w: [v for v in n if naive_near(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def spelled(seed=7):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀÿ×") for _ in range(rng.randint(6, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "baaaaaaa", "q" * 300, "q" * 299, "q" * 150 + "r" + "q" * 149]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 150)):
            w = rng.choice(base[: rng.randint(1, len(base))])
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "ÿ" + w[k + 1 :]])
            words.append(rng.choice([w, w.title() if w.isascii() else w]))
        rows.append((i, rng.choice([" ", ", ", "日", "\n", "1", "ā"]).join(words)))
    return rows + [(None, " ".join(base)), (200, None), (201, ""), (202, "日本語 ǅ"), rows[5]]


@pytest.mark.parametrize("tile", [1024, 4])
def test_spelling_variants(spark, tile):
    rows = spelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "key", "part", "size", "own", "root", "form")})
    got = spelling.spelling_variants(docs, tile)
    naive = naive_variants(naive_words(rows))
    assert sum(r[4] > 0 for r in naive) > 50 and any(r[1] for r in naive)
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in got.collect()), key=key) == naive
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(17)] + [("x", "w9")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()))
    assert set(got.values()) == {"w17"} and len(got) == 18


def test_spelling_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    n = naive_words(rows)
    # near words by their words without one place, each verified
    cut = {}
    for w in n:
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            cut.setdefault(x, []).append(w)
    near = {w: set() for w in n}
    for group in cut.values():
        for a in group:
            near[a] |= {b for b in group if naive_near(a, b)}
    got = {r.word: r for r in queries.op13_spelling(spark, DATA).collect()}
    assert set(got) == set(n)
    for w, r in got.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        fits = best is not None and n[best] >= 10 * n[w]
        assert (r.n, r.n_near, r.form, r.form_n) == (n[w], len(near[w]), best if fits else None, n[best] if fits else None)
