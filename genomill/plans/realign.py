"""Alignments along trees, realigned where the tree of the alignment differs; three-way weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import realign as R
from genomill.plans.alignments import aln
from genomill.plans.registry import query
from genomill.sources.scratch import stash
from genomill.sources.sequences import SHORT_SQL, short_seqs


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sets aligned along k-mer trees, the trees of identities found there, the sets realigned along those, and the merges that took."""
    s = short_seqs(spark, sf_dir).select("set_id", "seq_id", "seq")
    old = stash(R.tree_nodes(s, R.kmer_tree), "nodes")
    first = stash(R.aligned_along(s, old), "aligned")
    new = stash(R.tree_nodes(first, R.identity_tree), "nodes")
    again, made = R.realigned(first, old, new)
    return first, new, again, made


@query()
def realigned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of items realigned along the tree of their own alignment, with the merges made and those of a full run."""
    _, new, again, made = both(spark, sf_dir)
    n = made.groupBy("set_id").agg(F.count("*").alias("made"))
    of = new.where("level > 0").groupBy("set_id").agg(F.count("*").alias("merges"))
    counts = of.join(n, "set_id", "left").na.fill(0, ["made"])
    return again.join(counts, "set_id", "left").select("set_id", "seq_id", "seq", F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("merges", F.lit(0)).alias("merges"))


@query(f"WITH s AS ({SHORT_SQL}) SELECT set_id, count(*) AS n_rows, md5(string_agg(seq, ',' ORDER BY seq_id)) AS bare_md5, 1 AS widths, true AS as_full, true AS fewer FROM s GROUP BY set_id")
def realigned_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the realigned sets: their bare sequences, how many widths they have, whether all rows are those of a full run along the same tree, and whether merges were at most as many."""
    first, new, again, made = both(spark, sf_dir)
    again = stash(again, "realigned")
    full = R.aligned_along(first, new).withColumnRenamed("seq", "full")
    one = F.array_sort(F.collect_list(F.struct("seq_id", F.replace(F.col("seq"), F.lit("-"), F.lit("")).alias("bare"))))
    bare = F.md5(F.array_join(F.transform(one, lambda x: x["bare"]), ",").cast("binary"))
    facts = again.join(full, ["set_id", "seq_id"]).groupBy("set_id").agg(F.count("*").alias("n_rows"), bare.alias("bare_md5"), F.countDistinct(F.length("seq")).cast("int").alias("widths"), F.bool_and(F.col("seq") == F.col("full")).alias("as_full"))
    n = made.groupBy("set_id").agg(F.count("*").alias("made"))
    of = new.where("level > 0").groupBy("set_id").agg(F.count("*").alias("merges"))
    fewer = F.coalesce("made", F.lit(0)) <= F.coalesce("merges", F.lit(0))
    return facts.join(n, "set_id", "left").join(of, "set_id", "left").select("set_id", "n_rows", "bare_md5", "widths", "as_full", fewer.alias("fewer"))


@query()
def three_way_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way weights of the turns of conversations along the tree of their identities."""
    return R.weights_by_tree(aln(spark, sf_dir).select("set_id", "seq_id", "seq"), R.identity_tree, R.three_way_weights)


@query("SELECT conv_id AS set_id, count(*) AS n, 1.0::DOUBLE AS total, true AS positive FROM conversations GROUP BY conv_id")
def three_way_weight_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way weights of an alignment are positive or 0, and sum to 1."""
    w = three_way_weights(spark, sf_dir)
    return w.groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), (F.min("weight") >= 0).alias("positive"))
