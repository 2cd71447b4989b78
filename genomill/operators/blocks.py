"""Blocks aligned between their anchors: anchors, gaps and their alignments are rows, so that one long block is many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.operators.dp import together
from genomill.operators.extension import filling
from genomill.operators.frontier import pieces, recursive_matches
from genomill.operators.maximal import collinear
from genomill.sources.scratch import spread, stash

#: Gaps that a task gives back at once.
SENT = 256


def chains(anchors: DataFrame) -> DataFrame:
    """set_id, nth, starts, length: of a set's anchors those of most symbols that follow each other in every genome, in order. Only numbers are gathered, no sequences."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept = collinear([(tuple(s), n, 0) for s, n in zip(rows["starts"], rows["length"], strict=True)])
        return pd.DataFrame({"set_id": key[0], "nth": range(len(kept)), "starts": pd.Series([list(a[0]) for a in kept], dtype=object), "length": [a[1] for a in kept]})

    return spread(anchors.select("set_id", "starts", "length"), "set_id", heavy=True).groupBy("set_id").applyInPandas(run, "set_id long, nth long, starts array<long>, length long")


def gaps(chain: DataFrame, genomes: DataFrame) -> DataFrame:
    """set_id, nth, starts, ends, anchor: what lies before each anchor of a chain and, last, behind all, in every genome; anchor: its length there."""
    sizes = genomes.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.length("seq").cast("long").alias("n")))), lambda x: x["n"]).alias("to"))
    own = chain.select("set_id", "nth", F.col("starts").alias("to"), F.col("length").alias("anchor"))
    last = sizes.join(chain.groupBy("set_id").agg(F.max("nth").alias("nth")), "set_id", "left").select("set_id", (F.coalesce("nth", F.lit(-1)) + 1).alias("nth"), "to", F.lit(0).cast("long").alias("anchor"))
    w = Window.partitionBy("set_id").orderBy("nth")
    before = F.lag(F.transform("to", lambda p: p + F.col("anchor"))).over(w)
    return own.unionByName(last).select("set_id", "nth", F.coalesce(before, F.transform("to", lambda p: F.lit(0).cast("long"))).alias("starts"), F.col("to").alias("ends"), "anchor")


def _aligning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gaps of a batch are aligned side by side and given back as they are done, `SENT` at once."""
    for batch in batches:
        parts = batch.column("pieces")
        works = ((sum(map(len, p)), filling(p)) for p in ([x.decode() for x in row] for row in (parts[i].as_py() for i in range(len(batch)))))
        done: list[tuple[int, list[str]]] = []

        def sent(done: list[tuple[int, list[str]]] = done, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            own = batch.select(["set_id", "starts", "ends"]).take(pa.array([i for i, _ in done], pa.int64()))
            rows = pa.array([[r.upper() for r in rows] for _, rows in done], pa.list_(pa.string()))
            done.clear()
            return pa.RecordBatch.from_arrays([*own.columns, rows], names=["set_id", "starts", "ends", "rows"])

        for x in together(works):
            done.append(x)
            if len(done) == SENT:
                yield sent()
        yield sent()


def anchored_alignment(genomes: DataFrame, factor: float = 0.6, shortest: int = 5) -> DataFrame:
    """set_id, place, seq: each set aligned between its heaviest collinear anchors; anchors in lower case, all else in upper case.

    genomes: set_id, place, seq. The gaps of all sets are aligned independently, one a row, and put in order again.
    """
    genomes = stash(genomes.select("set_id", "place", "seq"), "genomes")
    parts = stash(gaps(chains(recursive_matches(genomes, factor, shortest)), genomes), "gaps")
    cut = spread(pieces(parts.select("set_id", "starts", "ends", F.lit(0).cast("long").alias("least")).distinct(), genomes), "set_id", "starts", "ends", of=genomes, heavy=True)
    aligned = cut.mapInArrow(_aligning, "set_id long, starts array<long>, ends array<long>, rows array<string>")
    both = parts.join(aligned, ["set_id", "starts", "ends"]).select("set_id", "nth", F.posexplode(F.arrays_zip("rows", "ends")).alias("place", "x"), "anchor")
    anchor = F.lower(F.substring(F.col("seq").cast("binary"), F.col("x.ends") + 1, F.col("anchor")).cast("string"))
    pieces_ = both.join(genomes, ["set_id", "place"]).select("set_id", "place", F.struct("nth", F.concat("x.rows", anchor).alias("seq")).alias("p"))
    return pieces_.groupBy("set_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["seq"]), "").alias("seq"))
