"""Document fingerprints: canonical exact digests.

A text is normalised (NFKC), case-folded, normalised again, and its runs of white space become one blank; the 128-bit
xxh3 of the canonical UTF-8 bytes is its bucket. Inside every bucket of several documents the canonical bytes are
compared: where they differ, each member's fingerprint gets its SHA-256 as a suffix, so equal fingerprints always mean
equal canonical texts.

Defined cases: null text counts as empty; rows with equal doc_id are ordered by text, null doc_id come last; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm.common import slices, stash

#: Most distinct repeated digests that are broadcast for the byte comparison (about 100 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _pair(digest, doc_id, text: str, canon: bytes, after: str, after_canon: bytes) -> dict:
    edited = edit(text, after)
    changed = canonical(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fp": digest(canon), "sha": hashlib.sha256(canon).hexdigest(), "edited_fp": digest(changed), "edited_sha": hashlib.sha256(changed).hexdigest(),
        "near_edited": float(changed == canon), "near_next": float(after_canon == canon),
    }


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fp", pa.string()), ("sha", pa.string()), ("edited_fp", pa.string()), ("edited_sha", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("first_text", pa.string()), ("last_text", pa.string()),
])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fp string, sha string, edited_fp string, edited_sha string, near_edited double, near_next double, part int, first_text string, last_text string"


def _neighbours(digest):
    """Rows in order: each gets its successor; the last one is left with the partition's outer texts, for the seams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, before = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                canon = canonical(text)
                if before is None:
                    first = text
                else:
                    out.append(_pair(digest, *before, text, canon))
                before = doc_id, text, canon
            yield pa.RecordBatch.from_pylist(out, schema=_ROW)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "part": part, "first_text": first, "last_text": before[1]}], schema=_ROW)

    return run


def _seams(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_pair(digest, r["doc_id"], r["last_text"], canonical(r["last_text"]), r["after"], canonical(r["after"])) for r in batch.to_pylist()], schema=_ROW)

    return run


def _canon_rows(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in canon], pa.string()), pa.array(canon, pa.binary())], names=["fp", "canon"])

    return run


def unequal_buckets(docs: DataFrame, digests: DataFrame, digest=digest) -> DataFrame:
    """The digests (column fp) that different canonical texts share.

    Only texts of repeated digests travel; a bucket is compared by the least and greatest of its byte strings, which
    partial aggregation keeps at one pair a task, however many copies there are.
    """
    repeated = digests.groupBy("fp").count().where("count > 1").select("fp")
    rows = docs.select("text").mapInArrow(_canon_rows(digest), "fp string, canon binary")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "fp", "left_semi").groupBy("fp").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("fp")


def fingerprints(docs: DataFrame, digest=digest) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document and of its edited text, and their likeness (1.0 equal, 0.0 not)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    rows = stash(docs.repartitionByRange(slices(docs, 1.7), order).sortWithinPartitions(order, "text").mapInArrow(_neighbours(digest), _DDL), "fingerprints")
    ends = rows.where("part is not null")
    every = Window.partitionBy(F.lit(0))  # one row of two numbers for each partition
    links = ends.select("part").withColumn("next", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)))
    seams = ends.select("part", "doc_id", "last_text").join(links, "part").join(ends.select(F.col("part").alias("next"), F.col("first_text").alias("after")), "next").select("doc_id", "last_text", "after").mapInArrow(_seams(digest), _DDL)
    keep = [c for c in rows.columns if c not in ("part", "first_text", "last_text")]
    found = rows.where("part is null").select(keep).unionByName(seams.select(keep))
    unequal = unequal_buckets(docs, found.select("fp"), digest)
    named = {"fp": "fingerprint", "edited_fp": "edited_fingerprint"}
    if bad := [r[0] for r in unequal.collect()]:  # differing texts of one 128-bit digest
        found = found.withColumns({c: F.when(F.col(c).isin(bad), F.concat_ws("-", c, c.replace("fp", "sha"))).otherwise(F.col(c)) for c in named})
    return found.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
