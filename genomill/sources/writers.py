"""Texts of the output formats, as columns; `save_text` writes them through Spark."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from genomill.functions.sequence import wrapped


def save_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def fasta_text(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width), F.lit("\n"))


def xmfa_header_text(idx: Column, file: Column, header: Column, length: Column) -> Column:
    return F.format_string("##SequenceIndex %d\n##SequenceFile %s\n##SequenceHeader >%s\n##SequenceLength %dbp\n", idx, file, header, length)


def xmfa_record_text(idx: Column, start: Column, end: Column, strand: Column, cluster: Column, contig: Column, pos: Column, seq: Column) -> Column:
    sign = F.when(strand > 0, "+").otherwise("-")
    return F.concat(F.format_string("> %d:%d-%d %s cluster%d s%d:p%d\n", idx, start, end, sign, cluster, contig, pos), wrapped(seq), F.lit("\n"))


def xmfa_text(records: DataFrame, order: str, record: str, group: str) -> DataFrame:
    """One block a cluster: its records in order, closed by '='."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, record))), lambda x: x[record])
    return records.groupBy(group).agg(F.concat(F.array_join(parts, ""), F.lit("=\n")).alias("block"))


def maf_line(stem: Column, contig: Column, pos: Column, strand: Column, contig_len: Column, seq: Column) -> Column:
    """An s line: on the reverse strand the start counts from the contig's end."""
    size = F.length(F.replace(seq, F.lit("-"), F.lit("")))
    start = F.when(strand > 0, pos).otherwise(contig_len - pos)
    return F.format_string("s %s#%s %d %d %s %d %s", stem, contig, start, size, F.when(strand > 0, "+").otherwise("-"), contig_len, seq)


def genbank_text(name: Column, seq: Column) -> Column:
    """A minimal GenBank entry: numbered lines of 60 bases in groups of ten."""
    n = F.ceil(F.length(seq) / 60).cast("int")
    line = lambda i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(F.lower(F.substr(seq, i * 60 + 1, F.lit(60))), "(.{10})", "$1 ")))
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), line)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("LOCUS       "), name, F.lit("\nVERSION     "), name, F.lit("  GI:"), name, F.lit("\nORIGIN\n"), F.array_join(lines, "\n"), F.lit("\n//\n"))


def phylip_text(rows: DataFrame, group: str = "set_id") -> DataFrame:
    """Sequential PHYLIP: a line with both sizes, then names padded to ten and sequences."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))), lambda x: F.concat(F.rpad(x["seq_id"].cast("string"), 10, " "), x["seq"]))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.max(F.length("seq")).alias("width"), lines.alias("lines")).select(group, F.concat(F.format_string("%d %d\n", "n", "width"), F.array_join("lines", "\n")).alias("text"))


def clustal_text(rows: DataFrame, marks: DataFrame, group: str = "set_id", width: int = 60) -> DataFrame:
    """CLUSTAL: blocks of `width` columns with a line of conservation marks (group, marks)."""
    own = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("seq_id", "seq"))).alias("own"))
    block = lambda i: F.concat(F.array_join(F.transform("own", lambda r: F.concat(F.rpad(r["seq_id"].cast("string"), 16, " "), F.substr(r["seq"], i * width + 1, F.lit(width)))), "\n"), F.lit("\n" + " " * 16), F.substr("marks", i * width + 1, F.lit(width)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("marks") / width).cast("int"), F.lit(1)) - 1), block)
    return own.join(marks, group).select(group, F.concat(F.lit("CLUSTAL multiple sequence alignment\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n")).alias("text"))


@F.pandas_udf(StringType())
def fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    """A number with so many digits behind the point, rounded from its exact binary value as C's printf does; Java rounds its shortest decimal form."""
    return pd.Series([None if pd.isna(v) else f"{v:.{d}f}" for v, d in zip(value, digits, strict=True)], dtype=object)


def msf_line(name: Column, width: Column, checksum: Column) -> Column:
    return F.format_string(" Name: %s  Len: %d  Check: %d  Weight: 1.00", name, width, checksum)


def bed_line(chrom: Column, start: Column, end: Column, score: Column) -> Column:
    return F.format_string("%s\t%d\t%d\tREC\t%.5f\t+", chrom, start, end, score)
