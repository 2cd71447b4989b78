"""Token counts without tokens: greedy longest-match lengths from a linear automaton.

Words are cut greedily into the longest pieces of a vocabulary whose first pieces carry the mark of a word start; characters
outside the vocabulary are taken apart into bytes. Each node of the vocabulary trie has a failure link and the number of
tokens that are popped when it is followed: the greedy tokens at the front of the node's string, after which the rest of
the string is again a trie path, the link's node. A word is read once, character by character, and its pieces are never
built; the counts of popped tokens are summed. Words that a worker has met are remembered.

Defined cases: null or empty text has no words and no tokens; words are runs of `[^\\x20\\x09-\\x0D]`; a character without a
piece counts as its UTF-8 bytes; repeated rows are documents of their own; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.llm.common import held

MARK = "▁"
#: Most words that a worker remembers before it starts anew.
REMEMBERED = 500_000
_BLANK = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


class Matcher:
    """The trie with failure links and popped counts. `pieces` may be any strings; single bytes are the fallback."""

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends, parent, via, depth = [False], [-1], [""], [0]
        for piece in sorted(set(pieces)):
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                    parent.append(node)
                    via.append(c)
                    depth.append(depth[node] + 1)
                node = self.next[node][c]
            ends[node] = bool(piece)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        # shallow nodes first: a link leads to a shallower node
        for node in sorted(range(1, n), key=depth.__getitem__):
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            c, up = via[node], parent[node]
            if up == 0:  # a character that is no piece: its bytes
                self.fail[node], self.popped[node] = 0, len(c.encode())
                continue
            z, count = self.fail[up], self.popped[up]
            while z > 0 and c not in self.next[z]:
                count += self.popped[z]
                z = self.fail[z]
            if c in self.next[z]:
                self.fail[node], self.popped[node] = self.next[z][c], count
            else:
                self.fail[node], self.popped[node] = 0, count + len(c.encode())

    def count(self, word: str) -> int:
        """Tokens of the greedy longest match over the whole string."""
        nxt, fail, popped, node, total = self.next, self.fail, self.popped, 0, 0
        for c in word:
            while node and c not in nxt[node]:
                total += popped[node]
                node = fail[node]
            if c in nxt[node]:
                node = nxt[node][c]
            else:
                total += len(c.encode())
        while node:
            total += popped[node]
            node = fail[node]
        return total


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def _counting(shared):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = held(("matcher", token), lambda: Matcher(shared.value)), {}  # built once a worker
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").translate(_BLANK).split(" ") if text and any(c in text for c in "\t\n\x0b\x0c\r") else (text or "").split(" ")
                for w in set(words).difference(known):
                    known[w] = matcher.count(MARK + w) if w else 0
                n_words.append(len(words) - words.count(""))
                n_tokens.append(sum(map(known.__getitem__, words)))
                if len(known) > REMEMBERED:
                    known = {}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words, n_tokens of every document; the vocabulary, a fixed table, is broadcast."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counting(docs.sparkSession.sparkContext.broadcast(pieces)), "doc_id long, n_words long, n_tokens long")
