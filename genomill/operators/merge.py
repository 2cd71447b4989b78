"""Merging alignments of partitions on the coordinates of their common reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_columns(a: DataFrame, b: DataFrame, group: str = "set_id") -> DataFrame:
    """Columns with one reference place become one column: letters of all sequences in order of seq_id."""
    n = lambda k: F.count(F.when(F.col("chunk") == k, 1))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "ch"))), lambda x: x["ch"]), "")
    return a.unionByName(b).groupBy(group, "ref_pos").agg(n(0).alias("n_first"), n(1).alias("n_second"), F.md5(letters.cast("binary")).alias("column_md5"))


def placed_columns(columns: DataFrame, group: str = "set_id") -> DataFrame:
    """Columns (group, chunk, seq_id, is_ref, col, ch) with ref_pos, the reference bases up to each, and ins: 0 at a base, then 1, 2, ... in an insertion."""
    w = Window.partitionBy(group, "chunk").orderBy("col")
    base = F.col("ch") != "-"
    ref = columns.where("is_ref").select(group, "chunk", "col", F.sum(base.cast("int")).over(w).alias("ref_pos"), (F.col("col") - F.coalesce(F.max(F.when(base, F.col("col"))).over(w), F.lit(-1))).alias("ins"))
    return columns.join(ref, [group, "chunk", "col"])


def merged_rows(columns: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, seq: the rows of all partitions side by side.

    Columns of one reference base become one. An insertion takes as many columns as its longest row in any partition; the
    letters of each row stand to the left in it. The reference, which every partition holds, comes from the first. Rows
    keep their bare sequence, and all rows of a group have one width.
    """
    placed = placed_columns(columns, group)
    first = placed.groupBy(group).agg(F.min("chunk").alias("first"))
    placed = placed.join(first, group).where(~F.col("is_ref") | (F.col("chunk") == F.col("first")))
    letters = F.transform(F.array_sort(F.collect_list(F.when((F.col("ins") > 0) & (F.col("ch") != "-"), F.struct("ins", "ch")))), lambda x: x["ch"])
    parts = placed.groupBy(group, "seq_id", "ref_pos").agg(F.coalesce(F.max(F.when(F.col("ins") == 0, F.col("ch"))), F.lit("")).alias("base"), F.array_join(letters, "").alias("own"))
    # every place of a group for every row: the reference has all places, other partitions lack the first's insertions
    widths = parts.groupBy(group, "ref_pos").agg(F.max(F.length("own")).alias("width"))
    placed_parts = parts.join(widths, [group, "ref_pos"]).withColumn("part", F.concat("base", F.rpad("own", F.col("width"), "-")))
    rows = placed_parts.groupBy(group, "seq_id").agg(F.array_sort(F.collect_list(F.struct("ref_pos", "part"))).alias("parts"))
    return rows.select(group, "seq_id", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("seq"))
