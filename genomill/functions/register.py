"""The expressions as SQL functions of a session, and the alignment kernels as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genomill.functions.sequence import CYCLE, LETTERS
from genomill.operators.trees import multiple_alignment

#: name and arguments, result, body; they are inlined into the plan.
INLINE = {
    "fold_sequence(s STRING)": ("STRING", f"regexp_replace(translate(s, '{LETTERS}', '{CYCLE}'), '[^ACGT]', 'N')"),
    "reverse_complement(s STRING)": ("STRING", "reverse(translate(s, 'ACGTU', 'TGCAA'))"),
    "gc_percent(s STRING)": ("DOUBLE", "100.0D * (2 * length(s) - length(replace(s, 'G', '')) - length(replace(s, 'C', ''))) / nullif(length(replace(s, 'N', '')), 0)"),
    "degap(s STRING)": ("STRING", "regexp_replace(s, '[-.]', '')"),
    "fragment_length(n BIGINT)": ("BIGINT", "least(3000, greatest(500, n div 100))"),
}


def register(spark: SparkSession) -> None:
    for head, (kind, body) in INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")

    @F.pandas_udf("array<string>")
    def msa(sets: pd.Series) -> pd.Series:
        return sets.map(lambda seqs: multiple_alignment([s or "" for s in seqs]))

    spark.udf.register("msa", msa)
