"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words (ASCII letters in lower case; runs of digits, letters and non-ASCII characters) and put
into one suffix automaton. A document's words stream through it while the longest matching length is tracked: where it
reaches `span` words, these words are a window of some item. An item shorter than `span` is one window of its own; each
state knows the short items that end in it. Words outside the items' vocabulary reset the match, so only runs of known
words are streamed. A document whose hits cover at least `coverage` of its words is contaminated; otherwise the matched
spans of at least `span` words can be cut out of its text.

The automaton is as large as the benchmark, about 0.8 KB a word: its items are broadcast and each worker builds it once, while
they hold at most `ITEM_WORDS` words; larger benchmarks are cut into slices of items, each with a pass of its own over the
documents, which adds to the ranges found before.

Defined cases: null text has no words; a document without words is clean; items without words never match; repeated items
are items of their own if their item_id differs; null item_id counts as an empty string; rows are documents, also where
they repeat; an empty benchmark or an empty table works; columns beside doc_id, text and item_id are not read, and
`decontaminate` keeps them under any name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import held, shielded, stash

SPAN, COVERAGE = 13, 20
ITEM_WORDS = 200_000
_KEEP = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Automaton:
    """Suffix automaton of several word sequences, with what each state needs to name the windows that end there."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int = SPAN):
        self.span, self.vocabulary = span, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        owners: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        self.least = min((min(span, len(w)) for _, w in items if w), default=span)
        for number, (_, sequence) in enumerate(items):
            last = 0
            for word in sequence:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                owners.setdefault(last, set()).add(number)
            if 0 < len(sequence) < span:
                short.setdefault(last, set()).add(number)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:  # every suffix of a match is in the states along its links
            if state in owners and self.length[self.link[state]] >= span:
                owners.setdefault(self.link[state], set()).update(owners[state])
        self.window = [frozenset(owners.get(s, ())) if s and self.length[s] >= span > self.length[self.link[s]] else None for s in range(len(self.length))]
        # short items: those whose whole sequence is the longest string of a state; found along the links
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for state in reversed(order):
            own = tuple((self.length[state], n) for n in sorted(short.get(state, ())))
            self.short[state] = own + self.short[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        """Standard online step, for several sequences: a transition that is there already is followed or split."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, transitions: dict) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def ranges(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges [from, to) that windows cover, joined where they touch, and the numbers of the items."""
        ids = np.fromiter(map(self.vocabulary.get, sequence, repeat(-1)), np.int64, len(sequence))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        found, items = [], set()
        span, nxt, link, length = self.span, self.next, self.link, self.length
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start < self.least:
                continue
            state, size = 0, 0
            for at, c in enumerate(ids[start:stop].tolist(), start + 1):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state, size = nxt[state][c], size + 1
                    reach = 0
                    if size >= span:
                        s = state
                        while length[link[s]] >= span:
                            s = link[s]
                        items |= self.window[s]
                        reach = span
                    for long, number in self.short[state]:
                        if long <= size:
                            items.add(number)
                            reach = max(reach, long)
                    if reach:
                        if found and at - reach <= found[-1][1]:
                            while found and at - reach <= found[-1][0]:
                                found.pop()
                            if found and at - reach <= found[-1][1]:
                                found[-1] = (found[-1][0], at)
                            else:
                                found.append((at - reach, at))
                        else:
                            found.append((at - reach, at))
        return found, items


def cut(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    data = text.encode()
    spans = [m.span() for m in _WORD.finditer(data.translate(_KEEP))]
    out, at = [], 0
    for a, b in ranges:
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return (b"".join(out) + data[at:]).decode()


def item_slices(benchmark: DataFrame, limit: int = ITEM_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in slices of about `limit` words, at least one slice; the driver holds one at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        w = words(r["text"])
        if size and size + len(w) > limit:
            yield out
            out, size = [], 0
        size += len(w)
        out.append((r["item_id"], w))
    yield out


def _scanner(shared, kept: list[str], first: bool, coverage: int | None):
    """coverage: where documents below the limit lose the matched spans of full length; null leaves texts as they are."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(("automaton", token), lambda: Automaton(*shared.value))  # once a worker, not once a task
        for batch in batches:
            texts = batch.column("text").to_pylist()
            before = zip(*([[[]] * len(texts)] * 2 if first else (batch.column(c).to_pylist() for c in ("ranges", "items"))), strict=True)
            n_words, ranges, items = [], [], []
            for i, (text, (old_ranges, old_items)) in enumerate(zip(texts, before, strict=True)):
                sequence = words(text)
                found, own = automaton.ranges(sequence)
                n_words.append(len(sequence))
                ranges.append(joined(found + [(r["a"], r["b"]) for r in old_ranges]))
                items.append(sorted({automaton.names[i] for i in own}.union(old_items)))
                if coverage and ranges[-1] and coverage * sum(r["b"] - r["a"] for r in ranges[-1]) < len(sequence):
                    texts[i] = cut(text, [(r["a"], r["b"]) for r in ranges[-1] if r["b"] - r["a"] >= automaton.span])
            added = [pa.array(n_words, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            same = [pa.array(texts, pa.string()) if c == "text" and coverage else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*same, *added], names=[*kept, "n_words", "ranges", "items"])

    return run


def joined(ranges: list[tuple[int, int]]) -> list[dict]:
    """Disjoint ranges in order."""
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(b, out[-1]["b"])
        else:
            out.append({"a": a, "b": b})
    return out


def scan(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, limit: int = ITEM_WORDS, remove_below: int | None = None) -> DataFrame:
    """The documents' columns, n_words, ranges (of words) and items (ids of items whose windows occur).

    remove_below: a coverage limit; documents with hits below it lose the matched spans of at least `span` words.
    """
    spark, kept = docs.sparkSession, docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    slices = item_slices(benchmark, limit)
    items, first = next(slices), True
    while items is not None:
        after = next(slices, None)
        shared = spark.sparkContext.broadcast((items, span))
        docs = docs.mapInArrow(_scanner(shared, kept, first, remove_below if after is None else None), f"{fields}, n_words long, ranges array<struct<a:int,b:int>>, items array<string>")
        if after is not None:
            docs = stash(docs, "scan")
        items, first = after, False
    return docs


def judged(scanned: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """Adds n_hit, n_items and contaminated: n_hit > 0 and coverage * n_hit >= n_words."""
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + r["b"] - r["a"])
    hit = scanned.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return hit.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, coverage: int = COVERAGE, remove_spans: bool = False) -> DataFrame:
    """The clean documents with all their columns; with `remove_spans`, those with hits below the coverage limit lose the matched spans."""
    bare, own = shielded(docs.withColumn("text", F.col("text").cast("string")), ("n_words", "ranges", "items", "n_hit", "n_items", "contaminated"))
    return judged(scan(bare, benchmark, span, remove_below=coverage if remove_spans else None), coverage).where("not contaminated").select(own)
