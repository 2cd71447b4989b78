"""Distances between sequences from counts of their k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most sequences of a set that are held against as many others at once.
BLOCK = 64
_CODES = np.full(256, 4, np.int64)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def spectrum(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mers (at most 27 symbols, N is one) as ascending numbers, and their counts."""
    codes = _CODES[np.frombuffer(seq.encode(), np.uint8)]
    n = max(len(codes) - k + 1, 0)
    value = np.zeros(n, np.int64)
    for i in range(k if n else 0):
        value = value * 5 + codes[i : i + n]
    return np.unique(value, return_counts=True)


def shared(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """k-mers of both, with multiplicity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def shared_kmers(pairs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """ref_id, query_id, c (shared k-mers) and the columns `keep` of pairs (ref_id, ref_seq, query_id, seq). Counts are made inside the row; nothing is shuffled."""
    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            c = []
            for ref_id, ref_seq, seq in zip(*(batch.column(x) for x in ("ref_id", "ref_seq", "seq")), strict=True):
                if ref_id != last:
                    last, own = ref_id, spectrum(ref_seq.as_py(), k)
                c.append(shared(own, spectrum(seq.as_py(), k)))
            yield pa.RecordBatch.from_arrays([batch.column("ref_id"), batch.column("query_id"), pa.array(c, pa.int64()), *(batch.column(x) for x in keep)], names=["ref_id", "query_id", "c", *keep])

    return pairs.select("ref_id", "ref_seq", "query_id", "seq", *keep).mapInArrow(run, "ref_id long, query_id long, c long" + extra)


def kmer_distances(s: DataFrame, k: int, fraction: bool = False, block: int = BLOCK) -> DataFrame:
    """set_id, a, b, d for each pair b < a of a set: shared k-mers, counted with multiplicity.

    Sets of any size: a set is cut into blocks of about `block` sequences, and a task holds two blocks. Of rows that repeat a
    seq_id each is a sequence of its own; pairs of one seq_id are left out.
    """
    sizes = s.groupBy("set_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    own = s.select("set_id", "seq_id", "seq").join(sizes, "set_id").withColumn("own", F.pmod(F.xxhash64("seq_id"), "blocks"))
    faced = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = faced.select("set_id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "seq_id", "seq")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found, (set_id, lo, hi) = [], rows.loc[rows.index[0], ["set_id", "lo", "hi"]]
        counts = [spectrum(x, k) for x in rows["seq"]]
        sizes, ids, own = [int(c[1].sum()) for c in counts], rows["seq_id"].tolist(), rows["own"].tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if b < a and (lo == hi or own[i] != own[j]):
                    least = min(sizes[i], sizes[j])
                    c = shared(counts[i], counts[j]) if least else 0
                    d = 1.0 if not least else 1 - c / least if fraction else 3.0 * (least - c) / least
                    found.append((set_id, a, b, d))
        return pd.DataFrame(found, columns=["set_id", "a", "b", "d"]).astype({"set_id": "int64", "a": "int64", "b": "int64", "d": "float64"})

    return keyed.groupBy("set_id", "lo", "hi").applyInPandas(run, "set_id long, a long, b long, d double")


#: Most k-mers whose hashes a task keeps.
KEPT = 1 << 20


def sketches(s: DataFrame, keep: list[str], k: int, size: int) -> DataFrame:
    """The columns `keep` and sk, the `size` least hashes of the k-mers in order, of sequences that have a k-mer.

    A hash is the number of the first 15 digits of the MD5, which keeps the MD5s' order. Each k-mer is hashed once a task.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select(keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            made = []
            for x in batch.column("seq"):
                seq = x.as_py()
                words = {seq[i : i + k] for i in range(len(seq) - k + 1)}
                for w in words.difference(known):
                    known[w] = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
                hashes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                made.append(np.sort(np.partition(hashes, size - 1)[:size] if len(hashes) > size else hashes))
                if len(known) > KEPT:
                    known = {}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.list_(pa.int64()))], names=[*keep, "sk"])

    return s.where(F.length("seq") >= k).select(*keep, "seq").mapInArrow(run, schema + ", sk array<long>")
