"""Streams of sequence records: composition by record, and counts over event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.functions.sequence import count_of
from genomill.sources.formats import fasta_records


def fasta_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records of FASTA files as they arrive in a folder."""
    texts = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return fasta_records(texts, "value")


def composition(records: DataFrame) -> DataFrame:
    """name, size, n_gc, n_n: no state, so any sink in append mode will do."""
    seq = F.col("seq")
    return records.select("name", F.length(seq).alias("size"), (count_of(seq, "G") + count_of(seq, "C")).alias("n_gc"), count_of(seq, "N").alias("n_n"))


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows a key and tumbling window; rows later than the watermark are not counted."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))
