"""Shared plumbing of the corpus operators: tables, shared scratch tables, ordered partitions."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of an Arrow batch.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few thousand at a time at most: Arrow's buffers lie outside the heap on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; where that is unset on one machine (tests) a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'corpus-scratch-' + spark.sparkContext.applicationId)}"
    return path.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*frames: DataFrame) -> None:
    """Deletes the files of stashed tables that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes that `df` reads; works for every file system."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices(df: DataFrame, factor: float = 1.0) -> int:
    """Partitions of about one scan split each, so that a task's data don't grow with the input; where the plan has no size, as many as a shuffle has."""
    spark, size = df.sparkSession, input_bytes(df)
    if size >= 1 << 60:  # the optimiser's mark of an unknown size
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(min(2 * spark.sparkContext.defaultParallelism, 1 + size // (1 << 20)), math.ceil(factor * size / split))


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a stashed or tiny table, marked for broadcast only where its counted rows stay within `rows`."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(docs: DataFrame) -> str:
    """A start of names that none of the columns has."""
    stem = "__own_"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem = "_" + stem
    return stem


def shielded(docs: DataFrame, taken: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """`docs` with columns of the taken names (in any case) renamed, and what selects its columns under their own names again."""
    lower, stem = {c.lower() for c in taken}, unused(docs)
    named = {c: f"{stem}{i}" if c.lower() in lower else c for i, c in enumerate(docs.columns)}
    return docs.toDF(*named.values()), [F.col(f"`{new}`").alias(old) for old, new in named.items()]


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps between tasks: the object of the last key only, so operators don't add up in memory."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Lets go of what an earlier operator's tasks left in this worker process, and gives the memory back to the system."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
            trim(0)


def chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, so that what is made of them stays small."""
    start = size = 0
    for i, text in enumerate(batch.column("text")):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size > most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < len(batch):
        yield batch.slice(start)
