"""Language identification of mixed-language text.

The scripts of a word's letters narrow its candidate languages to those that while learning had at least one of `RARE` of
their own words in that script, however few words the language has beside the others. A word's score in
a language is the log probability of its character n-grams (of 1 to 3 letters, with word ends), shared out between the candidates. A
Viterbi pass over the words of a text, in which changing the language costs `SWITCH`, labels its spans; the language of most
letters is the text's, and the score is its share of letters times the mean posterior of its words there.

For each text the Viterbi path is found exactly. The text's best single language is the best path if two things hold: no run
of words in another language gains more than one switch over it (so no path that uses it anywhere is better), and the best
other languages of all words together gain no more than one switch (so no path that avoids it is better). All other texts are
solved by the recurrence.

The model is learned from at most about `SAMPLE` labelled rows a language (those with the lowest hash of doc_id). It holds
every n-gram met there, with one number for each language that has it.

Defined cases: words are runs of letters and combining marks; null text, or text without a letter (digits, number symbols
and marks are none), is `und` with score 0; letters in no learned script leave all languages
as candidates; without any labelled row everything is `und`; ties go to the language first by code point; repeated rows are
documents of their own; empty tables work; columns other than text (and, for learning, doc_id and lang) are not read.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import chunks, held, small_batches

SAMPLE, SWITCH, UND = 1_000, 12.0, "und"
ORDER = 3
#: A language belongs to a script that at least one of so many of its own words has.
RARE = 1_000
#: Bytes of text whose words a worker holds at once.
CHUNK = 2_000_000
#: Most words whose scores a worker remembers before it starts anew.
REMEMBERED = 200_000
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+(?:['’\-]\p{L}[\p{L}\p{M}]*+)*+")
#: The same for texts without marks, number symbols and letters of other scripts, and what shows that a text has some.
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ODD = re.compile("[²³¹¼-¾\u0300-\u1fff\u2070-\U0010ffff]")

# First code point and script of ranges of letters.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2DE0, "cyrillic"), (0x2E00, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"),
    (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = [s for s, _ in SCRIPTS]


_LATIN = frozenset(("latin",))


def script(c: str) -> str:
    return SCRIPTS[max(0, bisect_right(_STARTS, ord(c)) - 1)][1]


def scripts(word: str) -> frozenset[str]:
    return _LATIN if max(word) < "\u0370" else frozenset(script(c) for c in set(word) if c.isalpha())


def _words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return finder(low).findall(low)


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)]


def finder(text: str):
    """The pattern of this text's words."""
    return _LETTERS if _ODD.search(text) else _WORD


class Model:
    """Log probabilities of n-grams by language, and the languages of each script."""

    def __init__(self, counts: dict[str, dict[str, int]], langs: list[str], by_script: dict[str, list[str]]):
        """counts: n-gram -> language -> count."""
        self.langs = sorted(langs)
        place = {x: i for i, x in enumerate(self.langs)}
        self.by_script = {s: frozenset(place[x] for x in own) for s, own in by_script.items()}
        self.place = {g: i for i, g in enumerate(counts)}
        kinds = np.bincount(np.fromiter(map(len, counts), np.int64, len(counts)), minlength=ORDER + 1)
        total = np.tile((0.5 * kinds + 1)[:, None], (1, len(self.langs)))
        for g, own in counts.items():
            for lang, n in own.items():
                total[len(g), place[lang]] += n
        # an n-gram that a language lacks has half a count; the others add what they have above that
        self.base = np.log(0.5 / total)
        self.start = np.cumsum([0, *map(len, counts.values())])
        self.lang = np.array([place[lang] for own in counts.values() for lang in own], np.int32)
        self.gain = np.log(np.array([n + 0.5 for own in counts.values() for n in own.values()]) / 0.5).astype(np.float32)
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.langs)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Log posteriors of the words among their candidates (a flat prior); other languages get a large loss."""
        get, at, sizes = self.place.get, [], []
        for w in words:
            own = [i for g in grams(w) if (i := get(g)) is not None]
            at += own
            sizes.append(len(own))
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        total = sum(np.maximum(length - n + 1, 0)[:, None] * self.base[n] for n in range(1, ORDER + 1))
        at = np.array(at, np.int64)
        n = self.start[at + 1] - self.start[at]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        cell = np.repeat(np.repeat(np.arange(len(words)), sizes), n) * len(self.langs) + self.lang[place]
        total = (total + np.bincount(cell, self.gain[place], total.size).reshape(total.shape)) / (ORDER / 2)  # n-grams overlap
        everything, latin = frozenset(range(len(self.langs))), self.by_script.get("latin", frozenset())
        for i, w in enumerate(words):
            own = scripts(w)
            found = latin if own is _LATIN else frozenset().union(*(self.by_script.get(s, ()) for s in own))
            if found and found != everything:
                total[i, list(everything - found)] -= 50.0
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total - np.log(np.exp(total).sum(axis=1, keepdims=True)), -8.0)  # one word never outweighs many

    def scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """A row for each word of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.matrix = {}, self.matrix[:0]
        known = self.known
        new = sorted({w for words in texts for w in words if w not in known})
        rows = [self.matrix]
        for k in range(0, len(new), 20_000):
            rows.append(self._rows(new[k : k + 20_000]).astype(np.float32))
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        self.matrix = np.concatenate(rows)
        return [self.matrix[np.fromiter(map(known.__getitem__, words), np.int64, len(words))] for words in texts]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The labels of the best path; staying is preferred to switching, lower labels to higher ones."""
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    gain = scores - scores[:, best : best + 1].astype(np.float64)
    others = np.delete(gain, best, axis=1)
    if others.size == 0 or others.max(axis=1).sum() <= switch:
        lead = np.cumsum(np.concatenate((np.zeros((1, scores.shape[1])), gain)), axis=0)
        if (lead - np.minimum.accumulate(lead)).max() <= switch:
            return np.full(len(scores), best)
    value, rows = scores[0].tolist(), scores.tolist()
    values = [value]
    for row in rows[1:]:
        changed = max(value) - switch
        value = [(v if v >= changed else changed) + s for v, s in zip(value, row, strict=True)]
        values.append(value)
    at = max(range(len(value)), key=value.__getitem__)
    path = [at] * len(rows)
    for t in range(len(rows) - 1, 0, -1):
        before = values[t - 1]
        top = max(before)
        if before[at] < top - switch:
            at = before.index(top)
        path[t - 1] = at
    return np.array(path)


def labels(texts: list[str | None], model: Model, spans: bool = False) -> list[tuple[str, float, list]]:
    """Language, score and, if asked for, spans (first character, end, language) of each text."""
    found = [[m.span() for m in finder(t or "").finditer(t or "")] for t in texts] if spans else [()] * len(texts)
    words = [[t[a:b].lower() for a, b in own] for t, own in zip(texts, found, strict=True)] if spans else [_words(t) for t in texts]
    if not model.langs:
        return [(UND, 0.0, [])] * len(texts)
    return [_labelled(w, f, s, model.langs) if w else (UND, 0.0, []) for w, f, s in zip(words, found, model.scores(words), strict=True)]


def _labelled(words: list[str], found: list, scores: np.ndarray, langs: list[str]) -> tuple[str, float, list]:
    path = viterbi(scores)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    share = np.bincount(path, weights=letters, minlength=len(langs))
    top = int(share.argmax())
    own = path == top
    certain = float((np.exp(scores[own, top].astype(np.float64)) * letters[own]).sum() / share[top])
    out: list = []
    for (a, b), lang in zip(found, path, strict=False):
        if out and out[-1][2] == langs[lang]:
            out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, langs[lang]))
    return langs[top], min(1.0, float(share[top] / letters.sum()) * certain), out


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in (part for whole in batches for part in chunks(whole, CHUNK)):
        words: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.update((lang, w) for w in _words(text))
        for (lang, w), n in words.items():
            for g in grams(w):
                counts[lang, g] += n
            for s in scripts(w):
                counts[lang, "#" + s] += n
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: doc_id, text, lang without null lang."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(2.0**53)).alias("at"))
    rates = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("rate")).collect()  # one row a language
    if not rates:
        return Model({}, [], {})
    drawn = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(rates, "lang string, rate double")), "lang").where("at < rate")
    summed = drawn.select("lang", "text").mapInArrow(_grams_of, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    grams_, words, totals = {}, {}, Counter()
    for r in summed.orderBy("gram").collect():  # the sample's n-grams of `ORDER` letters at most; no word has the mark of a script
        if r["gram"][0] == "#":
            words[r["gram"][1:]] = r["by"]
            totals.update(r["by"])
        else:
            grams_[r["gram"]] = r["by"]
    return Model(grams_, sorted(r["lang"] for r in rates), {s: [lang for lang, n in by.items() if RARE * n >= totals[lang]] for s, by in words.items()})


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """The documents' columns with lang_pred, score and, if asked for, spans."""
    columns, token = docs.columns, uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(("language", token), lambda: shared.value)
        for batch in (part for whole in batches for part in chunks(whole, CHUNK)):
            found = labels(batch.column("text").to_pylist(), own, spans)
            added = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                added.append(pa.array([[{"first": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, "lang_pred", "score", *["spans"] * spans])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * spans)


def training_rows(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Whether a document is held out, and the labelled documents that aren't."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return held_out, docs.where(~held_out & F.col("lang").isNotNull())
