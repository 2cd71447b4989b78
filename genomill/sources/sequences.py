"""Sequence relations from the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.functions.sequence import CYCLE, LETTERS, folded
from genomill.plans.registry import load
from genomill.sources.scratch import spread

SET = 8  # sequences in a collection that is compared or aligned as a whole

FOLD_SQL = f"regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{CYCLE}'), '[^ACGT]', 'N', 'g')"
SEQS_SQL = f"SELECT doc_id AS seq_id, lang, source, doc_id // {SET} AS set_id, {FOLD_SQL} AS seq FROM documents"
SHORT_SQL = f"SELECT item_id AS seq_id, item_id // {SET} AS set_id, {FOLD_SQL} AS seq FROM benchmark"


# turns of a conversation, aligned word by word: the k-th words of a set stand in the columns of its longest k-th word
FOLDED = f"regexp_replace(translate(w, '{LETTERS}', '{CYCLE}'), '[^ACGT]', 'N', 'g')"
TURNS_SQL = f"SELECT conv_id * 100 + turn AS seq_id, conv_id AS set_id, regexp_replace(translate(coalesce(text, ''), '{LETTERS}', '{CYCLE}'), '[^ACGT ]', 'N', 'g') AS words FROM conversations"
ALN_SQL = (
    f"s AS (SELECT seq_id, set_id, replace(words, ' ', '') AS seq FROM ({TURNS_SQL})), wd AS (SELECT set_id, seq_id, unnest(string_split(words, ' ')) AS w, generate_subscripts(string_split(words, ' '), 1) AS k FROM ({TURNS_SQL})), "
    "wk AS (SELECT set_id, k, CAST(max(length(w)) AS INTEGER) AS n FROM wd GROUP BY ALL), "
    "aln AS (SELECT s.set_id, s.seq_id, string_agg(rpad(coalesce(w, ''), n, '-'), '' ORDER BY wk.k) AS seq FROM s JOIN wk ON wk.set_id = s.set_id LEFT JOIN wd ON wd.seq_id = s.seq_id AND wd.k = wk.k GROUP BY s.set_id, s.seq_id)"
)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, set_id, words: the turns of every conversation as sequences, cut into words; a conversation is a set of any size."""
    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), folded)
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("seq_id"), F.col("conv_id").alias("set_id"), words.alias("words"))


def longest_words(sizes: DataFrame) -> DataFrame:
    """set_id, widths: the length of the longest k-th word of every stretch of rows (set_id, sizes) of one set. Rows stream through the task, which holds one set's widths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, most = None, None
        for batch in batches:
            keys, words, done = batch.column("set_id").to_numpy(), batch.column("sizes"), []
            at, size = words.offsets.to_numpy(), words.values.to_numpy()
            for i in range(len(batch)):
                own = size[at[i] : at[i + 1]]
                if now is not None and keys[i] == now:
                    if len(own) > len(most):
                        most = np.concatenate([most, np.zeros(len(own) - len(most), most.dtype)])
                    most[: len(own)] = np.maximum(most[: len(own)], own)
                else:
                    done += [] if now is None else [(now, most)]
                    now, most = keys[i], own.copy()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([w for _, w in done], pa.list_(pa.int32()))], names=["set_id", "widths"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([most], pa.list_(pa.int32()))], names=["set_id", "widths"])

    return sizes.mapInArrow(run, "set_id long, widths array<int>")


def aligned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """set_id, seq_id, seq: alignments of the turns of each conversation, with gaps inside the rows and at their ends.

    The texts are shuffled once, by set, and all that follows by set finds its rows where they are. Widths are made where the
    texts are read, from rows of a set that follow each other there, and then from those.
    """
    t = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("set_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq_id"), F.coalesce("text", F.lit("")).alias("text")).where("set_id is not null")
    partial = longest_words(t.select("set_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("sizes")))
    widths = longest_words(spread(partial, "set_id", of=t).withColumnRenamed("widths", "sizes").sortWithinPartitions("set_id"))
    line = F.regexp_replace(F.translate("text", LETTERS, CYCLE), "[^ACGT ]", "N")
    row = F.zip_with(F.split("line", " "), "widths", lambda w, n: F.rpad(F.coalesce(w, F.lit("")), n, F.lit("-")))
    return spread(t, "set_id").join(widths, "set_id").withColumn("line", line).select("set_id", "seq_id", F.array_join(row, "").alias("seq"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, lang, source, set_id, seq: the documents as sequences; a set is a collection of `SET` neighbours."""
    seq = folded(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "lang", "source", F.floor(F.col("doc_id") / SET).alias("set_id"), seq.alias("seq"))


def short_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, set_id, seq: the benchmark items, short enough for quadratic alignment."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), F.floor(F.col("item_id") / SET).alias("set_id"), folded(F.coalesce("text", F.lit(""))).alias("seq"))


def bounded(df: DataFrame, most: int = 32_000_000) -> DataFrame:
    """`df`, a small table such as one row a language, marked for broadcast only where its strings and rows stay within `most` bytes."""
    strings = [c for c, t in df.dtypes if t == "string"]
    size = df.agg(F.coalesce(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in strings), F.lit(64))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def references(s: DataFrame) -> DataFrame:
    """lang, ref_id, ref_seq, ref_len: the first sequence of each language. Only ids are grouped, so no sequence is sorted or shuffled."""
    first = s.groupBy("lang").agg(F.min("seq_id").alias("first"))
    own = s.select("lang", F.col("seq_id").alias("ref_id"), F.col("seq").alias("ref_seq"), F.length("seq").alias("ref_len"))
    return own.join(bounded(first.select("first")), own["ref_id"] == F.col("first"), "left_semi")
