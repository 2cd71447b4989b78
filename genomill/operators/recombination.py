"""Recombination hits as BED records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recombination_records(hits: DataFrame, flank: int = 50, limit: float = 0.01) -> DataFrame:
    """Places whose rounded p value lies in [0, limit), widened by the flank; of several with one start the last stays."""
    near = hits.where((F.col("p") >= 0) & (F.col("p") < limit)).withColumn("start", F.greatest(F.col("pos") - flank, F.lit(0)))
    last = F.row_number().over(Window.partitionBy("contig", "start").orderBy(F.col("event_id").desc()))
    return near.withColumn("rn", last).where("rn = 1").select(F.col("contig").alias("chrom"), "start", (F.col("pos") + flank).alias("end"), F.lit("REC").alias("name"), F.col("p").alias("score"), F.lit("+").alias("strand"))
