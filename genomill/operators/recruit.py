"""Which genomes take part: length, distance and identity filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def length_ratio(s: DataFrame, refs: DataFrame, on: list[str], low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Sequences of more than 20 symbols without gaps whose reference is between 0.8 and 1.2 times as long."""
    kept = s.where((F.length("seq") > 20) & ~F.col("seq").contains("-"))
    return kept.join(refs, on).withColumn("ratio", F.col("ref_len") / F.length("seq")).where((F.col("ratio") > low) & (F.col("ratio") < high))


def fast_cut(rows: DataFrame, group: str, limit: float = 0.5, most: int = 101) -> DataFrame:
    """Every distance below the limit that is at most three population deviations above the least of its group; least and
    deviation are those of the `most` smallest distances below the limit."""
    near = rows.where(F.col("d") < limit)
    # the `most` smallest of a group by partial aggregation: a sorted list that each task cuts, not a sort of the group
    keyed = near.select(F.col(group).alias("of"), "d").groupBy("of", F.spark_partition_id().alias("part")).agg(F.slice(F.array_sort(F.collect_list("d")), 1, most).alias("low"))
    least = keyed.groupBy("of").agg(F.slice(F.array_sort(F.flatten(F.collect_list("low"))), 1, most).alias("low"))
    cuts = least.select("of", F.explode("low").alias("d")).groupBy("of").agg((F.min("d") + 3 * F.stddev_pop("d")).alias("cut"))
    return near.join(cuts, F.col(group).eqNullSafe(F.col("of"))).where("d <= cut").drop("of")


def ani_group(rows: DataFrame, least: float, cover: float) -> DataFrame:
    """Of the pairs that reach the identity and the covered share, those of the reference with most genomes."""
    kept = rows.where((F.col("ani") >= least) & (100 * F.col("matched") / F.col("total") >= cover)).select("query", "ref").distinct()
    best = kept.groupBy("ref").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ref").limit(1).select("ref")
    return kept.join(F.broadcast(best), "ref", "left_semi").select("query", "ref")
