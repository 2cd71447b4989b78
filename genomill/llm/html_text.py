"""Main text of web pages by a maximum-scoring subsequence.

A page is cut into tags and words. Words score positive and tags negative, each by the logarithm of how much likelier it
is inside an article than outside, learned from labelled pages; one linear scan finds the contiguous run with the largest
sum, and its borders are those of the text. What the run holds is read block by block: white space inside a block becomes
one blank, blocks are joined by an empty line.

Labelled pages are those that mark their article themselves (one <article>, or else one <main> or role="main"): the words and
tags inside are positive, the rest negative. Every labelled page of the table counts; tags that HTML doesn't know count as one.
Learned are the weights of tags, of words, of words in links, and of the class and id names of the blocks around a word; the
model keeps the NAMES names with the most words. Names that by convention mark adverts, comments, menus and notices have a
weight before anything is learned; names are judged whole (`related-posts`, not `related-work`) and on blocks only.

A word's score is its own weight, that of the names around it, and MARKED if the page marks an article around it (its negative
if elsewhere; of several marks that with the most words). Before the scan, negative sub-runs are cut: blocks that
are never article text by their element or role (scripts, forms, navigation, asides, footers, page headers), and blocks with
a negative sum whose own name is negative or that are containers of MENU_LINKS links or more. What is cut scores nothing,
so the run goes on behind it. Where a page marks nothing, the run is widened to the element that just encloses it.

Defined cases: null or empty html gives the empty text; a page without words gives the empty text; tags that are never
closed end with the page; quotes count only after an equals sign; pages of any length and nesting take linear time; repeated
rows are pages of their own; an empty table gives no rows; url and page_id may be null; other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their role.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "select", "button", "noembed", "noframes", "audio", "video", "canvas", "head", "xmp")
HEAD = frozenset(("title", "meta", "link", "style", "script", "base", "noscript", "template"))
SKIP = frozenset(RAW[:-1] + ("nav", "aside", "footer", "form", "dialog", "menu", "fieldset"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label legend map mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
KNOWN = BLOCK | VOID | SKIP | INLINE
CONTAINERS = frozenset(("div", "section", "ul", "ol", "dl", "table", "tbody", "tr", "td", "center", "details", "header"))
NOISE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar", "alertdialog"))
# Parts of names that mark noise also inside an article, only outside of it, and parts that say nothing beside them.
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos banner cookie cookies consent notice notices newsletter subscribe signup popup modal nav navbar navigation"
    " menu menus breadcrumb breadcrumbs sidebar sidebars related recommended recommendations share sharing social pagination pager".split()
)
OUTER = frozenset("side widget widgets footer masthead toolbar login search skip copyright legal disclaimer hidden".split())
NEUTRAL = frozenset(
    "list area box block wrap wrapper container section bar left right top bottom slot unit post posts article articles link links form inner outer body content item items thread holder panel overlay title"
    " site page main primary secondary header text icons icon button buttons us media google reply story stories".split()
)

#: Class and id names that the model keeps: those with the most words.
NAMES = 20_000
#: What the mark of an article adds to a word inside it, and takes from one elsewhere on such a page.
MARKED = 3.0
#: A container of so many links, and of hardly anything else, is a menu.
MENU_LINKS = 3
#: Weight of names by convention, before anything is learned: inside and outside articles, outside only.
NOISE_WEIGHT, OUTER_WEIGHT = -6.0, -2.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes); kinds: text, open, close. Comments and raw contents don't appear, but for xmp's."""
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at, name = found.end(), (found[2] or "").lower()
        if not name:
            continue
        yield ("close" if found[1] else "open"), name, found[3]
        if not found[1] and name in _RAW_END and name != "head" and not _CLOSED.search(found[3]):
            ending = _RAW_END[name].search(page, at)
            begin, at = at, ending.start() if ending else end
            if name == "xmp":  # shown as it stands
                yield "text", page[begin:at].replace("&", "&amp;"), ""


def named(name: str) -> float:
    """Weight of a class or id name by convention: every part says noise or nothing, and at least one says noise."""
    parts = {p for p in re.split(r"[-_\d]+", name) if p}
    if parts & NOISE and parts <= NOISE | OUTER | NEUTRAL:
        return NOISE_WEIGHT
    return OUTER_WEIGHT if parts & OUTER and parts <= OUTER | NEUTRAL else 0.0


PLAIN, MARK, ROLE = range(3)


def traits(name: str, attributes: str) -> tuple[int, tuple[str, ...]]:
    """PLAIN, MARK (the article's own element) or ROLE (never article text, by element, role or style), and a block's class and id names."""
    names, role, hidden = [], "", name in SKIP
    for key, value in _ATTR.findall(attributes) if attributes and not hidden else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            names += value.split()
        elif key == "role":
            role = value
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    if hidden or role in NOISE_ROLES:
        return ROLE, ()
    if name in ("body", "html") or name not in BLOCK:
        names = ()
    return MARK if name in ("main", "article") or role == "main" else PLAIN, tuple(re.sub(r"\d+", "0", x[:40]) for x in names)


def feature(kind: str, name: str) -> str:
    """What a tag's weight is learned for."""
    known = name if name in KNOWN else "#other"
    return "/" + known if kind == "close" else known


def elements(seq: list) -> list[tuple[int, int, str, int, tuple[str, ...]]]:
    """(first token, token after the last, name, kind, class and id names) of every element, by its start; what isn't closed ends with its parent."""
    out, stack, depth = [], [], Counter()

    def pop(end: int) -> str:
        start, name, kind, names = stack.pop()
        depth[name] -= 1
        out.append((start, end, name, kind, names))
        return name

    for i, (kind, value, attributes) in enumerate(seq):
        if kind == "open":
            if stack and (value in BLOCK and stack[-1][1] == "p" or stack[-1][1] == "head" and value not in HEAD):
                pop(i)
            if value not in VOID and not _CLOSED.search(attributes):
                stack.append((i, value, *traits(value, attributes)))
                depth[value] += 1
        elif kind == "close" and depth[value]:
            while pop(i + 1) != value:
                pass
    while stack:
        pop(len(seq))
    return sorted(out)


def _covered(size: int, ranges: Iterable[tuple[int, int]]) -> list[bool]:
    """Which of `size` places lie in a range."""
    edges = [0] * (size + 1)
    for a, b in ranges:
        edges[a] += 1
        edges[b] -= 1
    return [n > 0 for n in accumulate(edges[:size])]


def zones(tree: list, words: list[int], size: int) -> list[tuple[int, int]]:
    """The outermost articles that a page marks, most words first; those of comments and other noise don't count. Without any, its <main>s."""
    mains = [0] * (size + 1)
    for start, _, name, kind, _ in tree:
        mains[start] = kind == MARK and name != "article"
    mains = [0, *accumulate(mains)]
    first = min((x[0] for x in tree if x[3] == MARK), default=size)

    def noise(start: int, stop: int, name: str, names: tuple) -> bool:
        if not any(named(x) == NOISE_WEIGHT for x in names) or mains[stop] > mains[start]:
            return False
        comments = any(COMMENTS & set(re.split(r"[-_\d]+", x)) for x in names)
        return comments or not start < first < stop

    dead = _covered(size, ((a, b) for a, b, name, kind, names in tree if kind == ROLE or noise(a, b, name, names)))
    for wanted in (True, False):
        found, end = [], 0
        for start, stop, name, kind, _ in tree:
            if kind == MARK and (name == "article") == wanted and not dead[start] and start >= end:
                found.append((start, stop))
                end = stop
        if found:
            return sorted(found, key=lambda x: (words[x[0]] - words[x[1]], x))
    return []


def parsed(page: str) -> tuple[list, list, list[int], list[tuple[int, int]]]:
    """Tokens, elements, words before each token, and the articles marked."""
    seq = list(tokens(page))
    tree = elements(seq)
    words = [0, *accumulate(len(v.split()) if k == "text" else 0 for k, v, _ in seq)]
    return seq, tree, words, zones(tree, words, len(seq))


def count_page(page: str, inside: Counter, outside: Counter) -> bool:
    """Adds a labelled page's words, tags and names to the counts; False if it doesn't mark exactly one article."""
    seq, tree, words, marks = parsed(page)
    if len(marks) != 1:
        return False
    begin, end = marks[0]
    end -= seq[end - 1][0] == "close"
    linked = _covered(len(seq), (x[:2] for x in tree if x[2] == "a"))
    for i, (kind, value, _) in enumerate(seq):
        at = inside if begin < i < end else outside
        if kind == "text":
            if n := words[i + 1] - words[i]:
                at["#link" if linked[i] else "#word"] += n
        else:
            at[feature(kind, value)] += 1
    for start, stop, _, kind, names in tree:
        if kind != ROLE and not start <= begin < stop and (n := words[stop] - words[start]):
            for x in names:
                (inside if begin < start < end else outside)["=" + x] += n
    return True


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log odds of each feature inside and outside: words at least slightly positive, tags and words in links at most slightly negative, names (with = in front) either."""
    plain = {k: v for k, v in counts.items() if k[0] != "="}
    total_in, total_out = (max(1, sum(v[k] for v in plain.values())) for k in (0, 1))
    score = {k: math.log((i + 0.5) / total_in) - math.log((o + 0.5) / total_out) for k, (i, o) in plain.items()}
    tag = lambda k, v: min(max(v, -0.5 if k.strip("/") in INLINE else -4.0), -0.02)
    out = {k: tag(k, v) for k, v in score.items()}
    out["#word"] = min(max(score.get("#word", 1.0), 0.05), 3.0)
    out["#link"] = min(max(score.get("#link", -1.0), -2.5), -0.02)
    words_in, words_out = (max(1, sum(plain.get(x, (0, 0))[k] for x in ("#word", "#link"))) for k in (0, 1))
    share = words_in / (words_in + words_out)
    for k, (i, o) in counts.items():
        if k[0] == "=":  # ten words as likely as any stand before those counted
            odds = math.log((i + 10 * share) / words_in) - math.log((o + 10 * (1 - share)) / words_out)
            out[k] = min(max(odds, NOISE_WEIGHT), MARKED)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; the first of several, the shortest at that start."""
    best, top, low, start, total = (0, 0), 0.0, 0.0, 0, 0.0
    for i, s in enumerate(scores):
        total += s
        if total - low > top + 1e-12:
            top, best = total - low, (start, i + 1)
        if total < low:
            low, start = total, i + 1
    return best


def scored(seq: list, tree: list, words: list[int], zone: tuple[int, int] | None, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """Each token's score, and which tokens negative sub-runs cut away; these score nothing."""
    size, known = len(seq), {}

    def weight(name: str) -> float:
        if name not in known:
            usual = named(name)
            learned = weights.get("=" + name, usual)
            known[name] = min(learned, usual) if usual == NOISE_WEIGHT else learned
        return known[name]

    begin, end = zone or (size, size)
    own, parent, links = [0.0] * len(tree), [-1] * len(tree), [0] * (size + 1)
    scores, stack, e = [0.0] * size, [(size, 0.0, 0.0, False, -1)], 0
    for i, (kind, value, _) in enumerate(seq):
        while stack[-1][0] <= i:
            stack.pop()
        while e < len(tree) and tree[e][0] == i:
            _, stop, name, _, names = tree[e]
            _, low, high, linked, parent[e] = stack[-1]
            if names and not i <= begin < stop:
                own[e] = min(map(weight, names))
                low, high = min(low, own[e]), max(high, max(map(weight, names)))
            links[i] += name == "a"
            stack.append((stop, low, high, linked or name == "a", e))
            e += 1
        within = begin < i < end
        if kind == "text":
            _, low, high, linked, _ = stack[-1]
            mark = (MARKED if within else -MARKED) if zone else 0.0
            scores[i] = (words[i + 1] - words[i]) * (weights["#link" if linked else "#word"] + low + high + mark)
        elif within:
            scores[i] = -0.02
        else:
            scores[i] = weights.get(feature(kind, value), -0.1 if value in INLINE else -1.0)
    text = [0.0, *accumulate(s if t[0] == "text" else 0.0 for s, t in zip(scores, seq, strict=True))]
    links = [0, *accumulate(links)]

    gone, ranges = [(0.0, 0)] * (len(tree) + 1), []  # what is cut inside an element: its sum, its links
    for e in range(len(tree) - 1, -1, -1):
        start, stop, name, kind, _ = tree[e]
        total, n = text[stop] - text[start], links[stop] - links[start]
        if start <= begin < stop:
            noise = False
        elif kind == ROLE or name == "header" and not begin < start < end:
            noise = True
        else:
            noise = total - gone[e][0] < -1e-9 and (own[e] < 0 or name in CONTAINERS and n - gone[e][1] >= MENU_LINKS)
        if noise:
            ranges.append((start, stop))
            gone[e] = total, n
        gone[parent[e]] = gone[parent[e]][0] + gone[e][0], gone[parent[e]][1] + gone[e][1]
    cut = _covered(size, ranges)
    return [0.0 if c else s for s, c in zip(scores, cut, strict=True)], cut


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The run with the best score, read without the negative sub-runs inside it; where no article is marked, widened to the element that just encloses it."""
    seq, tree, words, marks = parsed(page or "")
    zone = marks[0] if marks else None
    scores, cut = scored(seq, tree, words, zone, weights)
    start, stop = best_run(scores)
    if start < stop and not zone:
        around = min(((b - a, a, b) for a, b, name, _, _ in tree if a <= start and stop <= b and name in CONTAINERS), default=None)
        start, stop = around[1:] if around else (start, stop)
    return blocks(seq, cut, start, stop)


def blocks(seq: list, hidden: list[bool], start: int, stop: int) -> str:
    done, parts = [], []
    for i in range(start, stop):
        kind, value, _ = seq[i]
        if kind == "text":
            if not hidden[i]:
                parts.append(value)
        elif value in BLOCK and value != "br":
            done.append(parts)
            parts = []
        elif value == "br":
            parts.append(" ")
    done.append(parts)
    texts = (" ".join(entities.unescape("".join(p)).split()) for p in done)
    return "\n\n".join(t for t in texts if t)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        keys = sorted({*inside, *outside})
        columns = {"feature": keys, "n_in": [inside[k] for k in keys], "n_out": [outside[k] for k in keys]}
        inside.clear(), outside.clear()
        return pa.RecordBatch.from_pydict(columns, schema=pa.schema([("feature", pa.string()), ("n_in", pa.int64()), ("n_out", pa.int64())]))

    for batch in batches:
        for page in batch.column("html").to_pylist():
            count_page(page or "", inside, outside)
            if len(inside) + len(outside) > 100_000:
                yield rows()
    yield rows()


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights from all labelled pages; the driver gets one row for each kind of tag that HTML knows, and NAMES class and id names."""
    rows = pages.select("html").mapInArrow(_counts, "feature string, n_in long, n_out long")
    counts = rows.groupBy("feature").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    most = counts.orderBy(F.col("feature").startswith("="), F.desc(F.col("n_in") + F.col("n_out")), "feature").limit(NAMES + 4 * len(KNOWN))
    return weights_of({r[0]: (r[1], r[2]) for r in most.collect()})


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = weights or learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.mapInArrow(run, "page_id long, url string, text string")
