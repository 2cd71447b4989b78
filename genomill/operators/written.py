"""Blocks as they are written to a core-genome file: matches on one diagonal, trimmed against the block before, with places on contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import reverse_complement
from genomill.sources import writers as W

PAIR = ("ref_id", "query_id")


def diagonal_blocks(matches: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """ref_id, query_id, fwd, start, end, query_start, first, ref_row, query_row, cluster, clusters of every run of matches on a diagonal.

    Matches of a run lie at most `most` symbols apart; what lies between them is as long in both sequences and stands in
    capitals, matched symbols in small letters. `first` is the length of the first match; query places are those on its strand.
    A cluster's number is its place along the reference; clusters are counted before any is dropped.
    """
    diagonal = F.col("query_start") - F.col("ref_start")
    along = Window.partitionBy(*PAIR, "fwd", "diagonal").orderBy("ref_start")
    gap = F.col("ref_start") - F.lag(F.col("ref_start") + F.col("length")).over(along)
    near = F.coalesce(gap <= most, F.lit(False))
    m = matches.withColumn("diagonal", diagonal).withColumns({"near": near, "gap": F.when(near, gap).otherwise(0)}).withColumn("run", F.sum(1 - F.col("near").cast("int")).over(along))
    strand = F.when(F.col("fwd"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))

    def piece(seq: Column, at: Column) -> Column:
        at, gap = at.cast("int"), F.col("gap").cast("int")
        return F.concat(F.upper(F.substring(seq, at - gap + 1, gap)), F.lower(F.substring(seq, at + 1, F.col("length").cast("int"))))

    # pieces are made beside the sequences, so a sequence is carried to its matches once and the runs shuffle only what they write
    pieces = m.join(pairs, list(PAIR)).select(*PAIR, "fwd", "diagonal", "run", "ref_start", "query_start", "length", piece(F.col("ref_seq"), F.col("ref_start")).alias("a"), piece(strand, F.col("query_start")).alias("b"))
    inner = F.array_sort(F.collect_list(F.struct("ref_start", "length", "a", "b")))
    runs = pieces.groupBy(*PAIR, "fwd", "diagonal", "run").agg(F.min("ref_start").alias("start"), F.max(F.col("ref_start") + F.col("length")).alias("end"), F.min("query_start").alias("query_start"), inner.alias("x"))
    by = Window.partitionBy(*PAIR)
    return runs.select(
        *PAIR, "fwd", "start", "end", "query_start", F.col("x")[0]["length"].alias("first"), F.array_join("x.a", "").alias("ref_row"), F.array_join("x.b", "").alias("query_row"),
        F.row_number().over(by.orderBy("start", F.desc("fwd"), "query_start")).alias("cluster"), F.count("*").over(by).alias("clusters"),
    )


def columns_of_bases(row: Column, bases: Column) -> Column:
    """The fewest columns from the left that hold so many symbols other than '-'; all columns where there are fewer, none for 0."""
    places = F.filter(F.transform(F.split(row, "(?!^)"), lambda x, i: F.when((x != "-") & (x != ""), i + 1)), lambda i: i.isNotNull())
    return F.when(bases <= 0, 0).otherwise(F.coalesce(F.get(places, (bases - 1).cast("int")), F.length(row)))


def bare_length(row: Column) -> Column:
    return F.length(F.replace(row, F.lit("-"), F.lit("")))


def trimmed(blocks: DataFrame, least: int) -> DataFrame:
    """Blocks of more than `least` columns without the columns that hold reference symbols of blocks before; what then has `least` or fewer columns goes.

    Adds `lost_ref` and `lost_query`, the symbols of either row in the columns that were cut.
    """
    wide = blocks.where(F.length("ref_row") > least)
    before = F.max("end").over(Window.partitionBy(*PAIR).orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1))
    cut = wide.withColumn("overlap", F.greatest(F.coalesce(before, F.lit(0)) - F.col("start"), F.lit(0))).withColumn("cut", columns_of_bases(F.col("ref_row"), F.col("overlap")))
    lost = {f"lost_{side}": bare_length(F.left(f"{side}_row", "cut")) for side in ("ref", "query")}
    rest = {f"{side}_row": F.substr(f"{side}_row", F.col("cut") + 1) for side in ("ref", "query")}
    return cut.withColumns(lost).withColumns(rest).where(F.length("ref_row") > least).drop("overlap", "cut")


def contig_place(offsets: Column, start: Column, place: Column) -> tuple[Column, Column]:
    """Number of the contig that holds `start`, and `place` counted from its first symbol: from 1 on the first contig, from 0 on others."""
    number = F.greatest(F.size(F.filter(offsets, lambda o: o <= start)), F.lit(1))
    return number, place - F.coalesce(F.get(offsets, number - 1), F.lit(0)) + F.when(number == 1, 1).otherwise(0)


def block_texts(blocks: DataFrame, genomes: DataFrame) -> DataFrame:
    """ref_id, query_id, cluster, text of trimmed blocks. genomes: seq_id, size, offsets (starts of its contigs, ascending)."""
    side = lambda id_: genomes.select(F.col("seq_id").alias(id_), *(F.col(c).alias(f"{id_[:-3]}_{c}") for c in ("size", "offsets")))
    x = blocks.join(side("ref_id"), "ref_id").join(side("query_id"), "query_id")
    c = F.col
    width = bare_length(c("query_row")) + c("lost_query")
    start, stop = c("start") + c("lost_ref"), c("query_start") + width
    q_start = F.when(c("fwd"), c("query_start") + c("lost_query")).otherwise(c("query_size") - stop)
    q_end = F.when(c("fwd"), stop).otherwise(c("query_size") - c("query_start") - c("lost_query"))
    contig_a, pos_a = contig_place(c("ref_offsets"), start, start)
    contig_b, pos_b = contig_place(c("query_offsets"), F.when(c("fwd"), q_start).otherwise(c("query_size") - c("query_start") - c("first")), F.when(c("fwd"), q_start).otherwise(q_end))
    first = W.xmfa_record_text(F.lit(1), start + 1, start + bare_length(c("ref_row")), F.lit(1), c("cluster"), contig_a, pos_a, c("ref_row"))
    second = W.xmfa_record_text(F.lit(2), q_start + 1, q_end, F.when(c("fwd"), 1).otherwise(-1), c("cluster"), contig_b, pos_b, c("query_row"))
    return x.select(*PAIR, "cluster", F.concat(first, second, F.lit("=\n")).alias("text"))


def core_files(blocks: DataFrame, pairs: DataFrame, genomes: DataFrame, least: int) -> DataFrame:
    """ref_id, query_id, written, text: the file of every pair, also of those without a block. genomes as in `block_texts`, with file and header."""
    texts = block_texts(trimmed(blocks, least), genomes).groupBy(*PAIR).agg(F.count("*").alias("written"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "text"))), lambda t: t["text"]), "").alias("body"))
    counts = blocks.groupBy(*PAIR).agg(F.max("clusters").alias("clusters"))
    entry = lambda id_, i: genomes.select(F.col("seq_id").alias(id_), W.xmfa_header_text(F.lit(i), F.col("file"), F.col("header"), F.col("size")).alias(f"entry{i}"))
    files = pairs.select(*PAIR).join(counts, list(PAIR), "left").join(texts, list(PAIR), "left").join(entry("ref_id", 1), "ref_id").join(entry("query_id", 2), "query_id")
    head = F.concat(F.lit("#FormatVersion Mauve\n#SequenceCount 2\n"), "entry1", "entry2", F.format_string("#IntervalCount %d\n", F.coalesce("clusters", F.lit(0))))
    return files.select(*PAIR, F.coalesce("written", F.lit(0)).alias("written"), F.concat(head, F.coalesce("body", F.lit(""))).alias("text"))
