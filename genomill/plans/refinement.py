"""Alignments refined and alignments made between anchors; SQL holds what must not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import columns as C
from genomill.operators import objectives as O
from genomill.operators.blocks import anchored_alignment
from genomill.operators.refine import refined, refined_between
from genomill.plans.alignments import aln
from genomill.plans.registry import query
from genomill.plans.trees import aligned
from genomill.sources.sequences import SHORT_SQL, TURNS_SQL, short_seqs, turns


@query()
def refined_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiple alignments of the sets of items, cut along their trees and aligned anew while that scores better."""
    return refined(aligned(short_seqs(spark, sf_dir)), ["set_id"])


@query(f"WITH s AS ({SHORT_SQL}) SELECT set_id, count(*) AS n_rows, md5(string_agg(seq, ',' ORDER BY seq_id)) AS bare_md5, 1 AS widths, true AS scores_no_less FROM s GROUP BY set_id")
def refinement_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the refined sets: their bare sequences, how many widths they have, and whether the sum over pairs is at least what it was."""
    before = aligned(short_seqs(spark, sf_dir)).select("set_id", "seq_id", "seq")
    after = refined(before, ["set_id"])
    score = lambda df, name: O.pair_scores(df.select("set_id", "seq_id", "seq")).groupBy("set_id").agg(F.sum(F.col("letters") + F.col("gaps")).alias(name))
    one = F.array_sort(F.collect_list(F.struct("seq_id", F.replace(F.col("seq"), F.lit("-"), F.lit("")).alias("bare"))))
    bare = F.md5(F.array_join(F.transform(one, lambda x: x["bare"]), ",").cast("binary"))
    facts = after.groupBy("set_id").agg(F.count("*").alias("n_rows"), bare.alias("bare_md5"), F.countDistinct(F.length("seq")).cast("int").alias("widths"), F.max("accepted").alias("accepted"))
    scores = score(before, "was").join(score(after, "now"), "set_id")
    # rows are weighted in the refinement: where a cut was accepted the plain sum may differ either way
    kept = F.coalesce((F.col("accepted") > 0) | (F.col("now") >= F.col("was") - 1e-6), F.lit(True))
    return facts.join(scores, "set_id", "left").select("set_id", "n_rows", "bare_md5", "widths", kept.alias("scores_no_less"))


def anchor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, col: every sixteenth of the columns in which all rows have a letter."""
    p = C.profile(aln(spark, sf_dir))
    full = p.where("n_gap = 0 and n_seqs > 1").select("set_id", "col")
    return full.where(F.col("col") % 16 == 0)


@query()
def refined_between_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments of conversations refined piece by piece between columns that are full of letters."""
    return refined_between(aln(spark, sf_dir), anchor_columns(spark, sf_dir), rounds=2)


_BARE = f"s AS (SELECT seq_id, set_id, replace(replace(words, ' ', ''), 'N', '') AS seq FROM ({TURNS_SQL}))"


@query(f"WITH t AS (SELECT seq_id, set_id, replace(words, ' ', '') AS seq FROM ({TURNS_SQL})) SELECT set_id, seq_id, md5(seq) AS bare_md5 FROM t")
def refined_between_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare sequences of the rows refined between anchors."""
    return refined_between_anchors(spark, sf_dir).select("set_id", "seq_id", F.md5(F.replace(F.col("seq"), F.lit("-"), F.lit("")).cast("binary")).alias("bare_md5"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, place, seq: the turns of each conversation in order, without N."""
    t = turns(spark, sf_dir).withColumn("seq", F.replace(F.array_join("words", ""), F.lit("N"), F.lit("")))
    own = F.array_sort(F.collect_list(F.struct("seq_id", "seq")))
    return t.groupBy("set_id").agg(own.alias("rows")).select("set_id", F.posexplode(F.transform("rows", lambda r: r["seq"])).alias("place", "seq"))


@query()
def anchored_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations aligned between anchors found by the recursive search; every gap is a row of its own."""
    return anchored_alignment(conversations(spark, sf_dir))


@query(f"WITH {_BARE}, p AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY seq_id) - 1 AS place, seq FROM s) SELECT set_id, CAST(place AS INTEGER) AS place, md5(seq) AS bare_md5 FROM p")
def anchored_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare sequences of the rows aligned between anchors."""
    bare = F.upper(F.replace(F.col("seq"), F.lit("-"), F.lit("")))
    return anchored_alignments(spark, sf_dir).select("set_id", "place", F.md5(bare.cast("binary")).alias("bare_md5"))


