"""Pairwise paths and edit strings as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_string(row: Column) -> Column:
    """An alignment row as runs: n symbols are n, n gaps are -n."""
    runs = F.regexp_extract_all(row, F.lit("(-+|[^-]+)"), 1)
    return F.transform(runs, lambda r: F.when(r.startswith("-"), -F.length(r)).otherwise(F.length(r)))


def apply_edit_string(seq: Column, runs: Column) -> Column:
    """The row that an edit string makes of a sequence without gaps."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda a, r: F.struct(F.concat(a["out"], F.when(r < 0, F.repeat(F.lit("-"), -r)).otherwise(F.substr(seq, a["at"], r))).alias("out"), (a["at"] + F.greatest(r, F.lit(0))).alias("at"))
    return F.aggregate(runs, start, step)["out"]
