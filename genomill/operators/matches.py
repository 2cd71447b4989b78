"""Maximal unique matches between sequences, and chains of matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import reverse_complement
from genomill.operators.exact import Windows, codes_of, matches_of, unique_matches

#: Symbols of references whose windows a task keeps (some 30 bytes each).
KEPT = 1 << 24

_PAIRED = pa.schema([("ref_id", pa.int64()), ("query_id", pa.int64()), ("fwd", pa.bool_()), ("ref_start", pa.int64()), ("query_start", pa.int64()), ("length", pa.int64())])


def pair_matches(pairs: DataFrame, k: int, both_strands: bool = True) -> DataFrame:
    """ref_id, query_id, fwd, ref_start, query_start, length: maximal unique matches of each pair (ref_id, ref_seq, query_id, seq).

    Uniqueness is judged on each strand of the query; positions on the reverse strand count on the reversed query. Every
    pair is a row of its own, so nothing is shuffled and no group is collected.
    """
    strands = [(True, "seq"), (False, "back")] if both_strands else [(True, "seq")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed: dict[int, Windows] = {}  # a reference's windows serve all queries of the task
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                p = {c: batch.column(c)[i] for c in batch.schema.names}
                ref_id, query_id = p["ref_id"].as_py(), p["query_id"].as_py()
                if ref_id not in indexed:
                    if sum(len(w.codes) for w in indexed.values()) > KEPT:
                        indexed = {}
                    indexed[ref_id] = Windows(codes_of(p["ref_seq"].as_py()), k)
                rows += [(ref_id, query_id, fwd, starts[0], starts[1], length) for fwd, c in strands for starts, length in matches_of([indexed[ref_id], Windows(codes_of(p[c].as_py()), k)], k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PAIRED.types)], schema=_PAIRED)

    sent = pairs.select("ref_id", "query_id", "ref_seq", "seq", reverse_complement(F.col("seq")).alias("back"))
    return sent.mapInArrow(run, "ref_id long, query_id long, fwd boolean, ref_start long, query_start long, length long")


def multi_matches(s: DataFrame, k: int) -> DataFrame:
    """set_id, starts, length: maximal matches that every sequence of a set holds once; starts in order of seq_id. Sets of one have none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq_id")
        found = unique_matches(list(rows["seq"]), k) if len(rows) > 1 else []
        return pd.DataFrame({"set_id": pd.Series([rows["set_id"].iloc[0]] * len(found), dtype="int64"), "starts": pd.Series([list(p) for p, _ in found], dtype=object), "length": pd.Series([n for _, n in found], dtype="int64")})

    return s.select("set_id", "seq_id", "seq").groupBy("set_id").applyInPandas(run, "set_id long, starts array<long>, length long")


def mumi(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """ref_id, query_id, mumi: the share of the reference outside matches; 1 where lengths differ by more than 30 %, or a sequence is empty.

    A match as long as the whole reference counts from its second symbol, so an equal genome is at 1 / length.
    """
    w = Window.partitionBy("ref_id", "query_id").orderBy("ref_start", "length")
    far = F.max(F.col("ref_start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("ref_start") + F.col("length") - F.greatest(F.col("ref_start"), F.coalesce(far, F.lit(0))), F.lit(0))
    covered = matches.withColumn("new", new).groupBy("ref_id", "query_id").agg(F.sum("new").alias("covered"), F.max("length").alias("longest"))
    ratio = F.coalesce(F.try_divide("ref_len", "query_len"), F.lit(2.0))  # a sequence without bases is far from all others
    bases = F.coalesce(F.col("covered") - (F.col("longest") == F.col("ref_len")).cast("int"), F.lit(0))
    value = F.when((ratio > 1.3) | (ratio < 0.7), 1.0).otherwise(1 - bases / F.col("ref_len"))
    return pairs.join(covered, ["ref_id", "query_id"], "left").select("ref_id", "query_id", value.alias("mumi"))


def chained(m: DataFrame, group: str, order: list[str], genomes: int, d: int = 300, diag_diff: float = 0.12) -> DataFrame:
    """Adds lcb: matches in order of the reference join the one before if every genome keeps the strand, the gap lies in
    [0, d], and gaps are alike: least / greatest >= 1 - diag_diff (0 counts as 1).

    m has arrays start, end, fwd with a value for each genome, the reference first. Only the previous match matters, so one
    window over the group is enough.
    """
    w = Window.partitionBy(group).orderBy(*order)
    before = {c: F.lag(c).over(w) for c in ("start", "end", "fwd")}
    p = m.withColumns({f"p_{c}": x for c, x in before.items()})
    gaps = F.transform(F.sequence(F.lit(0), F.lit(genomes - 1)), lambda i: F.when(F.get("fwd", i), F.get("start", i) - F.get("p_end", i)).otherwise(F.get("p_start", i) - F.get("end", i)))
    fits = F.forall("gaps", lambda g: (g >= 0) & (g <= d)) & (F.col("fwd") == F.col("p_fwd"))
    least = F.least(F.array_min("gaps"), F.lit(d + 10))
    least, most = F.when(least == 0, 1).otherwise(least), F.when(F.array_max("gaps") == 0, 1).otherwise(F.array_max("gaps"))
    joins = F.col("p_start").isNotNull() & fits & (least / most >= 1 - diag_diff)
    flagged = p.withColumn("gaps", gaps).withColumn("breaks", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("lcb", F.sum("breaks").over(w)).drop("gaps", "breaks", "p_start", "p_end", "p_fwd")


def clusters(chain: DataFrame, group: str) -> DataFrame:
    """One row a cluster: number and summed length of its matches, first starts and last ends."""
    return chain.groupBy(group, "lcb").agg(F.count("*").alias("n_mums"), F.sum("length").alias("length"), F.min_by("start", F.col("start")[0]).alias("first_start"), F.max_by("end", F.col("start")[0]).alias("last_end"), F.min_by("end", F.col("start")[0]).alias("first_end"), F.max_by("start", F.col("start")[0]).alias("last_start"), F.first("fwd").alias("fwd"))


def long_clusters(c: DataFrame, group: str, least: int = 21) -> DataFrame:
    """Clusters longer than `least`; the last of a group by reference order is never tested."""
    last = F.row_number().over(Window.partitionBy(group).orderBy(F.col("lcb").desc())) == 1
    return c.withColumn("is_last", last).where((F.col("length") > least) | F.col("is_last")).drop("is_last")


def between_clusters(c: DataFrame, group: str, genomes: int, least: int = 5) -> DataFrame:
    """Regions between consecutive clusters that lie in the same order in all genomes, at least `least` long in each."""
    w = Window.partitionBy(group).orderBy("lcb")
    n = c.withColumns({"n_start": F.lead("first_start").over(w), "n_end": F.lead("first_end").over(w), "n_fwd": F.lead("fwd").over(w), "n_lcb": F.lead("lcb").over(w)})
    gaps = F.transform(F.sequence(F.lit(0), F.lit(genomes - 1)), lambda i: F.when(F.get("fwd", i), F.get("n_start", i) - F.get("last_end", i)).otherwise(F.get("last_start", i) - F.get("n_end", i)))
    return n.where("n_lcb is not null").withColumn("gaps", gaps).where((F.col("fwd") == F.col("n_fwd")) & F.forall("gaps", lambda g: g >= least)).select(group, "lcb", "n_lcb", "gaps")


def coverage(c: DataFrame, group: str, genomes: int) -> DataFrame:
    """Covered bases of each genome and of all (genome null): absolute distance from first start to last end."""
    each = F.transform(F.sequence(F.lit(0), F.lit(genomes - 1)), lambda i: F.struct(i.alias("genome"), F.abs(F.when(F.get("fwd", i), F.get("last_end", i) - F.get("first_start", i)).otherwise(F.get("first_end", i) - F.get("last_start", i))).alias("bases")))
    return c.select(group, F.explode(each).alias("x")).select(group, "x.genome", "x.bases").rollup(group, "genome").agg(F.sum("bases").alias("covered"), F.count("*").alias("n"))


def random_matches(m: DataFrame, group: str, order: list[str], genomes: int, most: int, reach: int = 5000) -> DataFrame:
    """Matches of at most `most` bases that lack a neighbour within `reach` after them or, but for the first, before them in any genome.

    The last match of a group is never tested. Gaps on a reversed genome count backwards.
    """
    w = Window.partitionBy(group).orderBy(*order)
    p = m.withColumns({f"{k}_{c}": f(c).over(w) for k, f in (("p", F.lag), ("n", F.lead)) for c in ("start", "end")})
    gap = lambda i, a, a_end, b, b_end: F.when(F.get("fwd", i), F.get(b, i) - F.get(a_end, i)).otherwise(F.get(a, i) - F.get(b_end, i))
    all_near = lambda *ends: F.forall(F.sequence(F.lit(0), F.lit(genomes - 1)), lambda i: gap(i, *ends).between(0, reach))
    after, before = all_near("start", "end", "n_start", "n_end"), all_near("p_start", "p_end", "start", "end")
    kept = after & (F.col("p_start").isNull() | before)
    return p.where((F.col("length") <= most) & F.col("n_start").isNotNull() & ~kept).drop("p_start", "p_end", "n_start", "n_end")


def compatible(d: DataFrame, group: str, bin_size: int = 64) -> DataFrame:
    """Diagonals (group, i, a, b, len; i in order of a) that agree with all others of their group.

    Two agree if they overlap on one diagonal or are apart on both axes. Of two that don't, the shorter one goes, or both
    unless one is more than four times as long. What is left is pairwise compatible; where its order on b differs from its
    order on a, the diagonals involved go as well: each that doesn't pass the furthest start so far, and the first of those
    before it that it doesn't pass. Pairs meet in the bins that they touch on either axis.
    """
    near = []
    for axis in ("a", "b"):
        bins = F.explode(F.sequence(F.floor(F.col(axis) / bin_size), F.floor((F.col(axis) + F.col("len") - 1) / bin_size)))
        x, y = (d.select(F.col(group).alias("g"), bins.alias("bin"), *(F.col(c).alias(f"{c}{k}") for c in ("i", "a", "b", "len"))) for k in (1, 2))
        overlap = lambda c: F.least(F.col(f"{c}1") + F.col("len1"), F.col(f"{c}2") + F.col("len2")) > F.greatest(f"{c}1", f"{c}2")
        near.append(x.join(y, ["g", "bin"]).where((F.col("i1") < F.col("i2")) & overlap(axis) & ~((F.col("a1") - F.col("b1") == F.col("a2") - F.col("b2")) & overlap("a"))).select("g", "i1", "i2", "len1", "len2"))
    bad = near[0].unionByName(near[1])
    losers = F.when(F.col("len1") > 4 * F.col("len2"), F.array("i2")).when(F.col("len2") > 4 * F.col("len1"), F.array("i1")).otherwise(F.array("i1", "i2"))
    gone = bad.select(F.col("g").alias(group), F.explode(losers).alias("i")).distinct()
    left = d.join(gone, [group, "i"], "left_anti")
    before = F.max("b").over(Window.partitionBy(group).orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    told = left.withColumn("passes", F.coalesce(F.col("b") > before, F.lit(True)))
    hit = F.first(F.when(F.col("passes"), F.col("i")), ignorenulls=True).over(Window.partitionBy(group).orderBy("b").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    struck = told.withColumn("i", hit).where("not passes").select(group, "i").distinct()
    return told.where("passes").drop("passes").join(struck, [group, "i"], "left_anti")
