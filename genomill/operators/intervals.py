"""Algebra of half-open intervals (start, end) within keys such as (chunk, contig)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 256
#: Width of the bins in which islands are found.
MERGE_BIN = 1 << 14


def _ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("start", "end")


def cut_overlaps(x: DataFrame, keys: list[str], order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Where an interval begins before the previous one's end, it begins one after that end; ends stay."""
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy(*order))
    return x.withColumn("start", F.when(before > F.col("start"), before + 1).otherwise(F.col("start")))


def disjoint(x: DataFrame, keys: list[str]) -> DataFrame:
    """No interval begins before one past the furthest end so far; those left empty go."""
    far = F.max("end").over(_ordered(keys).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("start", F.greatest("start", F.coalesce(far + 1, F.col("start")))).where("start < end")


def _carried(x: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the greatest value in earlier bins of the key. A bin sends one row, so only bins are sorted by key."""
    tops = x.groupBy(*keys, "bin").agg(F.max(value).alias("top"))
    before = F.max("top").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    told = tops.select(*(F.col(k).alias(f"of_{k}") for k in [*keys, "bin"]), before.alias(name))
    return x.join(told, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*keys, "bin"]]).drop(*(f"of_{k}" for k in [*keys, "bin"]))


def merged(x: DataFrame, keys: list[str], bin_size: int = MERGE_BIN) -> DataFrame:
    """Islands: the union as disjoint intervals; touching ones become one.

    A key is cut into bins by start, which are sorted on their own; what reaches in from earlier bins is carried over.
    """
    binned = x.select(*keys, "start", "end").withColumn("bin", F.floor(F.col("start") / bin_size))
    w = Window.partitionBy(*keys, "bin").orderBy("start", "end")
    far = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    marked = _carried(binned, keys, F.col("end"), "reach").withColumn("first", F.when(F.coalesce(F.col("start") > far, F.lit(True)), F.col("start")))
    # starts rise, so the last one is the greatest; rows of one start share it, whichever of them was met first
    peers = Window.partitionBy(*keys, "bin").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.coalesce(F.max("first").over(peers), F.col("begun"))
    return _carried(marked, keys, F.col("first"), "begun").withColumn("island", island).groupBy(*keys, F.col("island").alias("start")).agg(F.max("end").alias("end"))


def union_length(x: DataFrame, keys: list[str]) -> DataFrame:
    return merged(x, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("islands"))


def intersect(a: DataFrame, b: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """Overlaps of two lists. Intervals meet in the bins they touch, so a long key isn't one big product; a pair counts in the bin where its overlap begins."""
    spread = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)))
    x = a.where("start < end").select(*keys, F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("start"), F.col("end")).withColumn("bin", spread).drop("start", "end")
    y = b.where("start < end").select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("start"), F.col("end")).withColumn("bin", spread).drop("start", "end")
    both = x.join(y, [*keys, "bin"]).select(*keys, "bin", F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("end"))
    return both.where((F.col("start") < F.col("end")) & (F.floor(F.col("start") / bin_size) == F.col("bin"))).drop("bin")


def intersect_all(x: DataFrame, chunk: str, keys: list[str], chunks: int) -> DataFrame:
    """Stretches that all chunks cover: one sweep over begins and ends; each chunk's list is made disjoint first."""
    flat = merged(x, [chunk, *keys])
    events = flat.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.at", "e.step")
    depth = events.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    swept = depth.withColumn("depth", F.sum("step").over(w)).withColumn("end", F.lead("at").over(w))
    return swept.where(F.col("depth") == chunks).select(*keys, F.col("at").alias("start"), "end")


def complement(x: DataFrame, keys: list[str], sizes: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least `least` uncovered places, also before the first and after the last interval; sizes: keys, size. A key without intervals is one run."""
    ends = sizes.select(*keys, F.col("size").alias("start"), F.col("size").alias("end"))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = merged(x, keys).unionByName(ends).withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    return gaps.where(F.col("start") - F.col("before") >= least).select(*keys, F.col("before").alias("start"), F.col("start").alias("end"))


def neighbours(x: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest covered place on either side of each island; none before the first or after the last."""
    w = Window.partitionBy(*keys).orderBy("start")
    return merged(x, keys).withColumn("left_end", F.lag("end").over(w)).withColumn("right_start", F.lead("start").over(w))
