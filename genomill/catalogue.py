"""Every query of the reference operators, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genomill.plans import alignments, core, diagonals, extra, formats, intervals, matches, objectives, realign, recursion, refinement, rooting, sequences, trees, written  # noqa: F401  (each module registers its queries)
from genomill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["mumi"](spark, sf_dir)
