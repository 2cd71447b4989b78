"""Tables written between the rounds of an iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes of input, as stored, for one partition of a shuffle of whole rows.
PART = 4 << 20
#: Most partitions of a shuffle; the optimiser's sizes behind joins are products. Tasks a core of work that is heavy for its bytes.
MOST_PARTS, HEAVY = 4_000, 3


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` below the shared folder of `spark.checkpoint.dir` and reads it back: lineage is cut, lost executors lose nothing.

    Where the setting is missing, on a local master only, a folder of this machine.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'rounds-' + spark.sparkContext.applicationId)}"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None, heavy: bool = False) -> DataFrame:
    """`df` shuffled by keys into partitions that don't grow with the input: one for each `PART` bytes that `of`, or itself, reads; Spark's number where that is more.

    heavy: work that costs far more than its bytes say. It gets several tasks a core, also where few bytes or one file would make one.
    """
    spark = df.sparkSession
    size = int(str((of or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = 0 if size >= 1 << 60 else min(-(-size // PART), MOST_PARTS)  # the optimiser's mark of an unknown size
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if heavy:
        return df.repartition(max(parts, own, HEAVY * spark.sparkContext.defaultParallelism), *keys)
    return df.repartition(parts, *keys) if parts > own else df.repartition(*keys)
