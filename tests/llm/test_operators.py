"""Each corpus operator against a brute-force version, with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import html
import itertools
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from genomill.llm import decontaminate, fingerprint, html_text, language_id, line_dedup, minhash, mixing, queries, sharding, token_counts, token_file
from genomill.llm.queries import tokenizer

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
# names that the operators use themselves
CLASH = ("row", "size", "key", "start", "hub", "shard", "u", "rank", "score", "items", "ranges", "bucket", "tie", "p", "of", "copies", "n_words")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASH})


def sample(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(n - 12)]
    texts += [texts[0], texts[0], texts[1].upper(), None, "", " \n ", "x" * 3000 + " " + " ".join(vocabulary) * 20, "日本語 текст", texts[2] + " tail", "one", "one", "\n\n"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (rows[4][0], "another text of the same id", "en", "b", 5), (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(frame(spark, sample())).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# 1


def naive_canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"\s+", " ", t).strip()


def test_fingerprints(docs, nothing):
    got = fingerprint.fingerprints(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in sample()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        expected.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), float(naive_canonical(t) == naive_canonical(e)), float(naive_canonical(t) == naive_canonical(nxt))))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == sorted(expected)
    by = {}
    for r in got:
        if r.doc_id is not None and r.doc_id not in (3, 4):
            by[r.doc_id] = r.fingerprint
    texts = {r[0]: naive_canonical(r[1]) for r in sample() if r[0] is not None}
    assert all((by[a] == by[b]) == (texts[a] == texts[b]) for a in by for b in by)
    assert fingerprint.fingerprints(nothing).count() == 0


def test_fingerprint_collisions_are_told_apart(spark):
    """With a digest of two values nearly all buckets hold different texts; fingerprints still mean the canonical text."""
    texts = ["aa", "bb", "AA", "cc", "b  b", "B B", "d", "", None, "aa"]
    df = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df, digest=lambda canon: str(len(canon) % 2)).collect()}
    assert all((got[i] == got[j]) == (naive_canonical(x) == naive_canonical(y)) for i, x in enumerate(texts) for j, y in enumerate(texts))
    assert len(set(got.values())) == 6


# 2


def naive_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > limit * sizes[s]}
        if not over:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in over:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(docs, nothing, spark):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, _, s, _ in sample():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = naive_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert len(got) == len(sample()) and mixing.mix(nothing).count() == 0
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in target)  # a source may have few documents
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mixed(nothing).count() == 0


@pytest.mark.parametrize("block", [2_000, 60])
def test_sources_of_fifty_documents_meet_their_targets(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    by = defaultdict(list)
    for r in mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        by[r.source].append((r.size, r.copies, r.target))
    for rows in by.values():
        miss = abs(sum(size * n for size, n, _ in rows) - rows[0][2])
        assert len(rows) < 50 or miss <= max(0.01 * rows[0][2], sorted(x[0] for x in rows)[len(rows) // 2]), (len(rows), miss, rows[0][2])


def test_repair_leaves_no_better_single_change():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, start = rng.integers(0, 300, 40).astype(float), rng.uniform(0, 1, 40)
        x[0] = 9_000.0
        p = mixing.repair((rng.random(40) < start).astype(float), start, x)
        miss = (x * (p - start)).sum()
        assert set(p) <= {0.0, 1.0} and all(abs(miss) <= abs(miss + d) + 1e-6 for d in np.where(p > 0.5, -x, x)[x > 0])


def test_repair_of_few_documents_is_near_the_best_of_all_choices():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 10, 12):
        for _ in range(40):
            x, start = rng.integers(0, 4_000, n).astype(float), rng.uniform(0.05, 0.95, n)
            p = mixing.repair((rng.random(n) < start).astype(float), start, x)
            wanted = (x * start).sum()
            best = min(abs((x * way).sum() - wanted) for way in itertools.product((0, 1), repeat=n))
            miss = abs((x * p).sum() - wanted)
            assert set(p) <= {0.0, 1.0} and miss <= max(best + 1e-6, mixing.NEAR * wanted), (n, miss, best)


def test_repair_leaves_no_better_pair():
    rng = np.random.default_rng(6)
    for _ in range(30):
        x, start = rng.integers(1, 30_000, 60).astype(float), rng.uniform(0, 1, 60)
        p = mixing.repair((rng.random(60) < start).astype(float), start, x)
        miss, d = (x * (p - start)).sum(), np.where(p > 0.5, -x, x)
        assert all(abs(miss) <= abs(miss + d[i] + d[j]) + 1e-6 for i in range(60) for j in range(i))


def test_every_source_meets_its_target_or_its_best_choice(spark):
    by = defaultdict(list)
    for r in mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")).collect():
        by[r.source].append((r.size, r.copies, r.target, r.source_size))
    for source, rows in by.items():
        target, rate = rows[0][2], rows[0][2] / max(1, rows[0][3])
        miss = abs(sum(size * n for size, n, _, _ in rows) - target)
        if miss > 0.01 * target:
            assert len(rows) <= 16, (source, miss, target)
            best = min(abs(sum(x[0] * (int(rate + 1e-9) + n) for x, n in zip(rows, way, strict=True)) - target) for way in itertools.product((0, 1), repeat=len(rows)))
            assert miss <= 3 * best + 1e-6, (source, miss, best)


def test_own_columns_of_any_name_come_through(spark):
    columns = ["__key", "__copies", "__rows", "__each", "__own_0", "___own_key", "__nth", "a.b"]
    rows = [(i, f"word {'more ' * (i % 7)} {i}", "s", *(f"{c}{i}" for c in columns)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in columns))
    for out in (mixing.mixed(docs), minhash.deduplicated(docs)):
        got = out.collect()
        assert out.columns == docs.columns and got and {tuple(r) for r in got} <= set(rows)


def test_flight_keeps_totals_and_rates():
    rng = np.random.default_rng(1)
    x, p = rng.integers(1, 500, 300).astype(float), rng.uniform(0.05, 0.95, 300)
    hits = np.zeros(300)
    for _ in range(400):
        q = mixing.fly(p, x, rng.random(300))
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
        hits += mixing.land(q, x, rng.random(300))
    assert abs(hits / 400 - p).mean() < 0.03


# 3


def test_sharding(docs, nothing, spark):
    rows = [(i, f"text {i % 7}" if i % 3 == 0 else "hot" if i % 3 == 1 else f"own {i}", None, None, 0) for i in range(600)]
    for d, shards in ((docs, 4), (frame(spark, rows), 10), (nothing, 5), (frame(spark, rows[:3]), 10)):
        got = sharding.shard(sharding.nodes_of(d), shards).collect()
        n = d.count()
        sizes = Counter(r.shard for r in got)
        assert len(got) == n and all(sizes.get(s, 0) in (n // shards, -(-n // shards)) for s in range(shards))
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    got = sharding.shard(sharding.nodes_of(frame(spark, rows)), 10).collect()
    by = defaultdict(Counter)
    for r in got:
        by[r.hub][r.shard] += 1
    linked = [c for c in by.values() if sum(c.values()) > 1]
    cut = sum(1 - sum((n / sum(c.values())) ** 2 for n in c.values()) for c in linked if sum(c.values()) < 60)
    assert cut < 4 and len(max(by.values(), key=lambda c: sum(c.values()))) <= 7  # seven groups; the hot one needs four shards
    r = next(x for x in got if x.doc_id == 1)
    assert (r.size, r.text_crc32) == (19, zlib.crc32(b"hot"))


# 4

PAGE = "<html><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></li></ul></nav><div class='cookie-notice'>we use cookies</div>{}<aside><p>related things</p></aside><section id='comments'><p>first comment here</p></section><form><p>subscribe now</p></form><footer>&copy; us</footer></body></html>"
BODY = "<h1>The  title</h1><p>One &amp; two\n three<br>four <b>bold</b> &lt;tag&gt; word word word.<script>var x='<p>';</script></p><!-- no --><p>Second block has several more words in it.</p>"
TEXT = "The title\n\nOne & two three four bold <tag> word word word.\n\nSecond block has several more words in it."


def test_html_text(spark):
    pages = [(i, f"u{i}", PAGE.format(f"<{t}>{BODY}</{c}>")) for i, (t, c) in enumerate([("article", "article"), ("main", "main"), ("div id=content", "div")] * 4)]
    pages += [(50, None, None), (51, "u", ""), (52, "u", "<p>"), (53, "u", "plain words only"), (None, "u", PAGE.format(f"<article>{BODY}")), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumnsRenamed({}).selectExpr("*", "'clash' AS text", "1 AS n_in")
    got = html_text.main_text(df).collect()
    assert len(got) == len(pages) and html_text.main_text(df.limit(0)).count() == 0
    by = defaultdict(set)
    for r in got:
        by[r.page_id].add(r.text)
    assert all(by[i] == {TEXT} for i in [*range(12)]), by
    assert by[50] == by[51] == by[52] == {""} and by[53] == {"plain words only"} and by[None] == {TEXT}


def naive_article(page):
    """What a page's one <article> says, by plain replacements; good for pages without noise inside it."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    inner = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", inner)
    inner = re.sub(r"<br\s*/?>", " ", inner)
    parts = re.split(r"</?(?:p|div|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|pre|section|figure|figcaption|dl|dt|dd|hr)\b[^>]*>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts)
    return "\n\n".join(x for x in plain if x)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_every_page_gives_its_article(spark, tag):
    """Also when the page doesn't mark it; weights come from the table as it is."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.learn(pages)
    other = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit(f"<{tag}>")), F.lit("</article>"), F.lit(f"</{tag}>")))
    got = {r.page_id: r.text for r in html_text.main_text(other, weights).collect()}
    assert got == {r.page_id: naive_article(r.html) for r in pages.collect()}


def test_noise_goes_whatever_its_size_and_text_stays(spark):
    weights = html_text.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    text = lambda page: html_text.extract(page, weights)
    long = "<p>" + "a reader says this and that " * 60 + "</p>"
    short = "<p>Short article of a few good words here.</p>"
    said = "Short article of a few good words here."
    assert text(f"<body><article>{short}</article><section id='comments'>{long}</section></body>") == said
    assert text(f"<body><article>{short}<section id=comments>{long}</section></article></body>") == said
    assert text(f"<body><article>{short}<div class='ad'>{long}</div></article></body>") == said
    assert text(f"<body><article>{short}<section id='comments'><article class='comment'>{long}</article></section></article></body>") == said
    assert text(f"<body class='comments-open has-sidebar'><div class='page sidebar-left'><article><h1>Head</h1>{short}</article></div></body>") == "Head\n\n" + said
    assert text(f"<article>{short}<p class='legal'>Legal words.</p><div class='side'>Side words.</div></article>") == f"{said}\n\nLegal words.\n\nSide words."
    assert text("<article><p>One two three.</p><p data-x=it's>Four five six.</p><p>It's seven.</p></article>") == "One two three.\n\nFour five six.\n\nIt's seven."
    assert text("<html><head><title>t</title><body><article><p>No end of the head.</p></article>") == "No end of the head."
    assert text("<article><p>a <a href=/x/>link</a> in it<p>next</article>") == "a link in it\n\nnext"


def test_the_run_makes_the_text(spark, monkeypatch):
    """Another run gives another text on every page: its first token where the article is marked, the page's end where the run is widened."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    weights = html_text.learn(spark.createDataFrame([(p,) for p in pages], "html string"))
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    best = html_text.best_run
    for some, other in ((pages, lambda x: (best(x)[0], best(x)[0] + 1)), (plain, lambda x: (len(x) - 1, len(x)))):
        monkeypatch.setattr(html_text, "best_run", best)
        right = [html_text.extract(p, weights) for p in some]
        monkeypatch.setattr(html_text, "best_run", other)
        assert not any(a == html_text.extract(p, weights) for a, p in zip(right, some, strict=True))


def test_negative_runs_go_and_names_inside_the_text_stay(spark):
    short, said = "<p>Short article of a few good words here.</p>", "Short article of a few good words here."
    long = "<p>" + "a reader says this and that " * 60 + "</p>"
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry</a></li>" for k in range(8)) + "</ul>"
    cases = [
        (f"<article>{short}<section id=discussion><h2>Discussion</h2><p>We see.</p></section></article>", [said, "Discussion", "We see."]),
        (f"<article>{short}<section class=related-work><p>Others did.</p></section></article>", [said, "Others did."]),
        (f"<article>{short}<p class=reply>Yes.</p><p class=promotion>He rose.</p></article>", [said, "Yes.", "He rose."]),
        (f"<article>{short}<pre><code>x <span class=comment># note</span></code></pre></article>", [said, "x # note"]),
        (f"<article>{short}<p>Sum <math><mi>a</mi></math> is.</p><xmp><b>&amp;</b> c</xmp></article>", [said, "Sum a is.", "<b>&amp;</b> c"]),
        (f"<article>{short}<p class=notice>We use cookies.</p><p class=newsletter>Sign up.</p></article>", [said]),
        (f"<article>{short}{menu}</article>", [said] + ["Menu entry"] * 8),
        (f"<body><article>{short}</article><section id=comments><h1>Comments</h1>{long}</section></body>", [said]),
        (f"<body><article>{short}</article><section id=comments><article>{long}</article><article>{long}</article></section></body>", [said]),
        (f"<body><div>{short * 3}</div><section id=comments><h1>Comments</h1>{long}</section></body>", [said] * 3),
        (f"<body><div id=wrap><div class=top>{menu}</div>{short * 3}</div></body>", [said] * 3),
        (f"<body><div id=wrap><div class=top>{menu}</div><h1>Title</h1>{short * 3}<div>{short}</div></div></body>", ["Title"] + [said] * 4),
        (f"<main><article><h1>T</h1>{short * 3}</article><section><article><h3>Other story</h3><p>Its summary.</p></article></section></main>", ["T"] + [said] * 3),
    ]
    for weights in (html_text.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), html_text.weights_of({})):
        for page, parts in cases:
            assert html_text.extract(page, weights) == "\n\n".join(parts), page


def test_names_are_learned_from_labelled_pages():
    """A name that only ever stands beside articles goes, also inside a page's own; one seen within stays."""
    inside, outside = Counter(), Counter()
    page = "<body><article><p>{0}</p><div class=zing>{0}</div></article><div class=zang>{0}</div></body>".format("some words of a page " * 20)
    for _ in range(20):
        assert html_text.count_page(page, inside, outside)
    weights = html_text.weights_of({k: (inside[k], outside[k]) for k in {*inside, *outside}})
    assert html_text.extract("<article><p>One two three.</p><div class=zang>four five</div><div class=zing>six</div></article>", weights) == "One two three.\n\nsix"
    assert weights["=zang"] < -4 < 0 < weights["=zing"]


def test_deep_and_long_pages_take_linear_time():
    import time

    def seconds(n):
        page = "<article>" + "<div class='ad'>" * n + "x" + "</div>" * n + "<p>words here</p>" * n + "</b>" * n + "</article>"
        began = time.process_time()
        assert html_text.extract(page, html_text.weights_of({})) == "\n\n".join(["words here"] * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 8 * 2 * max(seconds(2_000), 0.02)


def test_few_labelled_pages_among_many_make_the_weights(spark):
    from pyspark.sql import functions as F

    marked = [(i, f"u{i}", PAGE.format(f"<article>{BODY}</article>")) for i in range(3)]
    plain = spark.range(10, 40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("url"), F.lit("<p>no mark</p>").alias("html"))
    some = spark.createDataFrame(marked, "page_id long, url string, html string")
    assert html_text.learn(some.unionByName(plain)) == html_text.learn(some) != html_text.weights_of({})


def test_best_run_is_the_best():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-3, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == pytest.approx(max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))]))


# 5


def naive_count(word: str, pieces: set[str]) -> int:
    """The definition: take the longest piece at the front, else the first character's bytes."""
    at = total = 0
    longest = max(map(len, pieces), default=0)
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
        total += 1 if size else len(word[at].encode())
        at += size or 1
    return total


def test_token_counts(docs, nothing):
    pieces = token_counts.pieces_of(tokenizer("piece_bpe_32k.model"))
    known = set(pieces)
    got = Counter((str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, pieces).collect())
    expected = Counter()
    for i, t, *_ in sample():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        expected[str(i), len(words), sum(naive_count("▁" + w, known) for w in words)] += 1
    assert got == expected and token_counts.token_counts(nothing, pieces).count() == 0


def test_matcher_on_random_vocabularies():
    rng = random.Random(9)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        m = token_counts.Matcher(pieces)
        for _ in range(20):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14)))
            assert m.count(w) == naive_count(w, pieces), (w, pieces)


# 6


def naive_lines(rows, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= least and max(holders[key(x)]) != (-(2**63) if i is None else i))]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("limit", [10, 0])
def test_line_dedup(spark, docs, nothing, limit):
    a, b = "A frequent line of more than forty characters, é", "b" * 40
    rows = [(i, f"{a if i % 2 else a.lower()}  \nown {i}\n\t{b if i < 6 else 'short'}\n{a}" if i else None) for i in range(9)] + [(8, a), (None, b), (20, ""), (21, "x\r\n"), (22, b[:39])]
    df = clashing(frame(spark, [(i, t, None, None, 0) for i, t in rows]))
    small = {"broadcast_keys": limit, "shard_keys": 1, "block": 3}  # without the broadcast: several shards, and several copies of that of the hot line
    got = line_dedup.dedup_lines(df, **small).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept) for r in got) == naive_lines(rows)
    assert line_dedup.dedup_lines(nothing, **small).count() == 0


def test_keys_of_one_index_value_are_kept_apart():
    import pandas as pd

    keys = [struct.pack("<QQ", i, c) for i, c in ((7, 1), (7, 2), (8, 3), (9, 4))]
    built = line_dedup._build(pd.DataFrame({"shard": 0, "key": keys, "n_docs": [2, 3, 4, 5], "last_doc": [20, 30, 40, 50]}))
    shard = line_dedup.Shard(*built.iloc[0][["parts", "check", "count", "last", "twins"]])
    asked = [*keys, struct.pack("<QQ", 7, 9), struct.pack("<QQ", 8, 9), struct.pack("<QQ", 1, 1)]
    count, last = shard.probe(*line_dedup._split(asked))
    assert count.tolist() == [2, 3, 4, 5, 0, 0, 0] and last.tolist() == [20, 30, 40, 50, 0, 0, 0]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys).dump())
        assert sorted(h.find(keys).tolist()) == list(range(len(keys)))


# 7


def test_language_id(spark, nothing):
    got = queries.op7_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    docs = clashing(frame(spark, sample()))
    held, labelled = language_id.training_rows(docs)
    model = language_id.learn(labelled)
    found = language_id.identify(docs.select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in found if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert all((r.lang_pred == "und") == (r.score == 0) for r in found) and len(found) == len(sample())
    assert language_id.identify(nothing.select("text"), language_id.learn(nothing)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.select("text"), language_id.learn(nothing)).collect()} == {"und"}


def test_rare_languages_stay_candidates_of_their_script(spark):
    rng = random.Random(11)
    letters = {"aa": "bcdfo", "bb": "ghjke", "cc": "lmnpi", "dd": "qrstu", "rare": "vwxyza"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    rows = [(lang, text(lang, 500)) for lang in ("aa", "bb", "cc", "dd") for _ in range(50)] + [("rare", text("rare", 20)) for _ in range(4)]
    model = language_id.learn(frame_of(spark, rows))
    held = [(lang, text(lang, 30)) for lang in letters for _ in range(20)]
    assert [x[0] for x in language_id.labels([t for _, t in held], model)] == [lang for lang, _ in held]
    stray = language_id.learn(frame_of(spark, [("aa", text("aa", 2000)), ("aa", "\u0434\u0430"), ("bb", "\u043d\u0435\u0442 " * 9)]))
    assert {s: [stray.langs[i] for i in own] for s, own in stray.by_script.items()} == {"latin": ["aa"], "cyrillic": ["bb"]}


def frame_of(spark, rows):
    return spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(100):
        s, penalty = rng.normal(0, 3, (rng.integers(1, 6), 3)), rng.uniform(0, 6)
        score = lambda p: sum(s[t, a] for t, a in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        best = max(score(p) for p in np.ndindex(*[3] * len(s)))
        assert score(language_id.viterbi(s, penalty)) == pytest.approx(best)


def test_viterbi_leaves_the_best_single_language():
    s = np.array([[5, -8, 0], [5, -8, 0], [-8, 5, 0], [-8, 5, 0]], float)
    assert language_id.viterbi(s, 12.0).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(6)
    for _ in range(300):  # scores floored as the model's are, long enough for several switches
        s, penalty = np.maximum(rng.normal(-2, 4, (7, 3)), -8), rng.uniform(2, 14)
        value = lambda p: sum(s[t, a] for t, a in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: E731,B023
        assert value(language_id.viterbi(s, penalty)) == pytest.approx(max(map(value, np.ndindex(*[3] * 7))))


def test_language_of_every_document_by_brute_force(spark):
    """Labels from the definition: n-gram scores word by word and the whole recurrence, for all documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(language_id.training_rows(docs)[1])
    counts, sizes = defaultdict(Counter), [Counter() for _ in range(4)]
    for r in language_id.training_rows(docs)[1].collect():  # fewer than the sample
        for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", (r.text or "").lower()):
            for g in language_id.grams(w):
                counts[g][r.lang] += 1
                sizes[len(g)][r.lang] += 1
    kinds = Counter(map(len, counts))

    def row(w):
        total = np.array([sum(np.log((counts.get(g, {}).get(x, 0) + 0.5) / (sizes[len(g)][x] + 0.5 * kinds[len(g)] + 1)) for g in language_id.grams(w)) / 1.5 for x in model.langs])
        total -= total.max()
        return np.maximum(total - np.log(np.exp(total).sum()), -8.0)

    rows, n = {}, 0
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    for r in docs.where("length(text) < 1500").collect():
        words = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", (r.text or "").lower())
        if not words or max(map(max, words)) > "\u02ff":
            continue
        s = np.array([rows[w] if w in rows else rows.setdefault(w, row(w)) for w in words])
        value, back = s[0].copy(), []
        for x in s[1:]:
            top = int(value.argmax())
            stay = value >= value[top] - language_id.SWITCH
            back.append(np.where(stay, np.arange(len(value)), top))
            value = np.where(stay, value, value[top] - language_id.SWITCH) + x
        at = int(value.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        share = np.bincount(path[::-1], weights=list(map(len, words)), minlength=len(model.langs))
        n += 1
        assert got[r.doc_id] == model.langs[int(share.argmax())], r.doc_id
    assert n > 50


def test_words_are_letters_with_their_marks(spark):
    assert language_id._words("½ ² ① 12_ \u0301") == [] and language_id.labels(["½ ² ①"], language_id.Model({"<": {"a": 1}}, ["a", "b"], {}))[0][:2] == ("und", 0.0)
    assert language_id._words("Hindī हिन्दी भाषा, naïve’s “x”") == ["hindī", "हिन्दी", "भाषा", "naïve’s", "x"]


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(docs.where("lang is not null"))
    texts = {r.lang: r.text for r in docs.where("length(text) > 600").collect()}
    both = texts["en"][:400] + " " + texts["de"][:400]
    spans = language_id.labels([both], model, spans=True)[0][2]
    assert [x[2] for x in spans] == ["en", "de"] and abs(spans[0][1] - 400) < 40


# 8


def naive_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, own = words(text), set(), set()
    for name, t in items:
        v = words(t)
        size = min(13, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                own.add(name)
    ids = ",".join(sorted(own))
    return len(w), len(hit), len(own), hashlib.sha256(ids.encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_decontamination(spark, nothing, limit):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([20, 13, 14, 5, 2, 1, 0, 40])] + [(8, None), (3, "a second text, same id"), (9, "Ünï W1, w2!")]
    texts = [" ".join(rng.choice([*words, "zzz"]) for _ in range(rng.randint(0, 60))) for _ in range(20)]
    texts += [items[0][1].upper() + " more words", "zzz " * 300 + items[1][1], items[7][1][5:90], items[3][1] + ", " + items[4][1], None, "", "zzz"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    docs = clashing(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]))
    from pyspark.sql import functions as F

    got = decontaminate.judged(decontaminate.scan(docs.select("doc_id", "text"), bench, limit=limit)).withColumn("h", F.sha2(F.array_join("items", ","), 256)).collect()
    named = [(str(i), t) for i, t in items]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.h, r.contaminated) for r in got) == sorted((i, *naive_hits(t, named)) for i, t in enumerate(texts))
    clean = decontaminate.decontaminate(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, t in enumerate(texts) if not naive_hits(t, named)[4]] and clean.columns == DOCS.names
    assert decontaminate.scan(nothing.select("doc_id", "text"), bench).count() == 0
    assert decontaminate.judged(decontaminate.scan(docs.select("doc_id", "text"), bench.limit(0))).where("contaminated").count() == 0


def test_spans_are_cut():
    assert decontaminate.cut("Keep this, CUT these words! and keep", [(2, 5)]) == "Keep this, ! and keep"


def test_spans_go_from_documents_below_the_limit(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:15])), (2, "tiny item")], "item_id long, text string")
    filler = [f"own{i}" for i in range(400)]
    texts = [" ".join(filler[:200] + words[:14] + filler[200:]), " ".join(words[:15]), "tiny item " + " ".join(filler), " ".join(filler), None]
    docs = clashing(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]))
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove_spans=True).collect()}
    assert got == {0: " ".join(filler[:200]) + "  " + " ".join(filler[200:]), 2: texts[2], 3: texts[3], 4: None}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()} == {i: t for i, t in enumerate(texts) if i != 1}
    assert decontaminate.decontaminate(docs, bench, remove_spans=True).columns == docs.columns


# 9


def test_token_file(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    token_file.token_file(docs, path, f"file://{tmp_path}/f")
    got = token_file.read_tokens(spark, f"file://{tmp_path}/f", with_ids=True).collect()
    assert [r.start for r in sorted(got, key=lambda r: r.start)] == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    expected = Counter()
    for i, text, *_ in sample():
        own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected[str(i), len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)), tuple(own)] += 1
    assert Counter((str(r.doc_id), r.n_tokens, r.ids_crc32, tuple(np.frombuffer(r.ids, np.uint16).tolist())) for r in got) == expected
    assert token_file.token_file(nothing, path).count() == 0


def test_code_lengths_are_limited_and_optimal():
    import heapq

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 400):
        counts = np.zeros(1000, np.int64)
        counts[rng.choice(1000, n, False)] = np.maximum(1, rng.pareto(0.6, n) * 3).astype(np.int64)
        lengths = token_file.code_lengths(counts)
        used = lengths[counts > 0].astype(float)
        assert (2.0**-used).sum() <= 1 and used.max() <= 16 and (lengths[counts == 0] == 0).all()
        heap = sorted(counts[counts > 0].tolist())
        total = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            total += a + b
            heapq.heappush(heap, a + b)
        loose = token_file.code_lengths(counts, 40) if n > 1 else lengths
        assert n == 1 or int((loose * counts).sum()) == total
    with pytest.raises(ValueError):
        token_file.code_lengths(np.ones(10, np.int64), 3)


# 10


def shingles(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def naive_groups(texts, least=0.8):
    s, up = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((s[i] & s[j]).values())
            if both and both >= least * sum((s[i] | s[j]).values()):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 120))) for _ in range(25)]
    for base in (0, 1, 2):
        chain = texts[base].split()
        for _ in range(8):  # each step close to the one before, the ends far apart
            chain = chain[:]
            chain[rng.randrange(len(chain))] = rng.choice(words)
            texts.append(" ".join(chain))
    hot = texts[3].split()
    texts += [" ".join(hot + [f"tail{i}"]) for i in range(15)] + [texts[4]] * 6 + [texts[5].upper() + "!"]
    return texts + [None, "", "one two", "one two", "one two three", "a " * 500, "a " * 460]


def test_near_groups(spark, nothing):
    texts = near_texts()
    docs = clashing(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]))
    expected = naive_groups(texts)
    got = minhash.near_groups(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(expected))
    sizes = Counter(expected)
    assert all(r.class_size == sizes[r.class_id] and r.is_first == (r.doc_id == r.class_id) for r in got)
    assert minhash.near_groups(nothing).count() == 0
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected))


@pytest.mark.parametrize(("bands", "block"), [(180, 7), (36, 3)])
def test_mixed_buckets_are_resolved(spark, bands, block):
    """With one component a band nearly everything shares buckets, so most links come from resolving them, in many small blocks."""
    texts = near_texts()
    got = minhash.near_groups(frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), bands=bands, block=block).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(naive_groups(texts)))
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).selectExpr("doc_id AS row", "doc_id", "doc_id AS tag", "text")
    signed = docs.mapInArrow(minhash._signing(bands, 180), minhash._SIGNED_DDL).where("key is not null").collect()
    assert {len(r.buckets) for r in signed} == {bands}
    shared = Counter(b for r in signed for b in set(r.buckets))
    assert max(shared.values()) > block  # buckets of several blocks


def test_recall_on_the_tables(spark):
    """Every pair of likeness 0.8 or more, by comparing all documents that share a shingle, lies in one group."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    every = [shingles(r.text) for r in rows]
    holders, pairs = defaultdict(list), Counter()
    for i, s in enumerate(every):
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        for k, i in enumerate(own):
            pairs.update((j, i) for j in own[:k])
    near = [(i, j) for i, j in pairs if sum((every[i] & every[j]).values()) >= 0.8 * sum((every[i] | every[j]).values())]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in near:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(near) > 50 and got == {rows[i].doc_id: rows[find(i)].doc_id for i in range(len(rows))}


def test_odd_rows(spark, docs):
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(sample()) and {r.class_size for r in got if r.doc_id == 50} == {1}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for k in range(150):
        n, most = int(rng.integers(5, 300)), (2, 5, 60)[k % 3]
        items = np.unique(rng.integers(0, 2**40, n).astype(np.uint64))
        w = rng.integers(1, most, len(items))
        v = np.where(rng.random(len(items)) < rng.random(), w, rng.integers(0, most, len(items)))
        a, b = (items, w), (items[v > 0], v[v > 0])
        if len(b[0]) == 0:
            continue
        true = np.minimum(w, v).sum() / np.maximum(w, v).sum()
        same = (minhash.signatures(*a, np.array([0, len(a[0])]), 512) == minhash.signatures(*b, np.array([0, len(b[0])]), 512)).mean()
        if 0 < true < 1:
            errors.append((same - true) / (true * (1 - true) / 512) ** 0.5)
    assert abs(np.mean(errors)) < 0.35 and 0.75 < np.std(errors) < 1.3
