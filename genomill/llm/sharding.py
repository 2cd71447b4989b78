"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked through hubs (here: equal texts). Each document starts in a shard drawn by hash. In every turn a hub
elects the open shard that holds most of its members (several, if it is larger than a shard), and its other members ask to
move there. Moves into a shard are accepted up to its quota: with room for the fraction r of the moves, the hubs whose
hash lies below r go as a whole (of a hub as large as a shard: the documents). Documents without links count as room,
since they can live anywhere; in the end exactly as many documents as a shard has too many, those without links first, go
to shards with too few. Counts of shards then differ by one at most (law `rows`).

A hub may hold a third of all rows: votes are aggregated before they are shuffled, members find their hub's election by
(hub, salt), and ranks within a shard come from counts of small buckets, so no task sorts a shard. The driver sees a few
numbers a shard.

Defined cases: null text counts as empty, without bytes; equal texts are one hub whatever their doc_id; repeated rows are
documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genomill.llm.common import small, stash, unstash

SHARDS = 40
TURNS = 5
SALTS = 16
#: Rows of a rank bucket on average, and most bucket offsets that are broadcast.
BUCKET, OFFSETS = 20_000, 200_000


def nodes_of(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hub of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("hub"))


def unit(*cols) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(2.0**53)


def ranked(rows: DataFrame, group: str, first: Column, total: int) -> DataFrame:
    """Adds `rank` from 0 within the group: rows with `first` = 0 come first, each class in order of column u, in [0, 1)."""
    buckets = max(1, total // BUCKET)
    cut = rows.withColumn("bucket", F.floor(F.col("u") * buckets).cast("int") + first.cast("int") * buckets)
    before = F.sum("n").over(Window.partitionBy(group).orderBy("bucket")) - F.col("n")
    offsets = cut.groupBy(group, "bucket").agg(F.count("*").alias("n")).select(group, "bucket", before.alias("before"))
    local = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("u", "doc_id")) - 1
    return cut.withColumn("local", local).join(small(offsets, OFFSETS), [group, "bucket"]).withColumn("rank", F.col("before") + F.col("local")).drop("bucket", "local", "before")


def by_shard(rows: DataFrame, shards: int) -> list[int]:
    """Rows a shard; the column `shard` has no others."""
    found = dict(rows.groupBy("shard").count().collect())
    return [found.get(s, 0) for s in range(shards)]


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def elections(members: DataFrame, capacity: int) -> DataFrame:
    """hub, salt, wants: the shards with most of a hub's members, one for each `capacity` members; ties by hash, so they spread."""
    votes = members.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")), asc=False)  # a row a shard at most
    hubs = votes.groupBy("hub").agg(F.sum("n").alias("members"), order.getField("shard").alias("order"))
    wants = F.slice("order", F.lit(1), F.ceil(F.col("members") / capacity).cast("int"))
    return hubs.where("members > 1").select("hub", wants.alias("wants"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def propagate(nodes: DataFrame, shards: int, turns: int, total: int) -> DataFrame:
    """Adds `linked` and moves linked documents between shards, within quotas that hold on average."""
    capacity = max(1, total // shards)
    repeated = nodes.groupBy("hub").count().where("count > 1").select("hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("linked"))
    nodes = stash(nodes.join(repeated, ["hub", "salt"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "nodes")
    rest, links = nodes.where("not linked"), nodes.where("linked")
    state, kept = links, []
    for turn in range(turns):
        full = [n >= 0.98 * capacity for n in by_shard(state, shards)]
        open_ = state.where(~pick(full, F.col("shard")))
        wants = elections(open_, capacity).withColumnRenamed("salt", "_salt").withColumnRenamed("hub", "_hub")
        asks = state.join(wants, (F.col("hub") == F.col("_hub")) & (F.col("salt") == F.col("_salt")) & ~pick(full, F.col("shard")), "left").drop("_hub", "_salt")
        want = F.when(F.array_contains("wants", F.col("shard")), F.col("shard")).otherwise(F.element_at("wants", (F.floor(unit("hub", "u", F.lit(turn)) * F.size("wants")) + 1).cast("int")))
        asks = stash(asks.withColumn("want", F.coalesce(want, F.col("shard"))).withColumn("large", F.coalesce(F.size("wants") > 1, F.lit(False))).drop("wants"), "moves")
        moves = by_shard(asks.where("want <> shard").drop("shard").withColumnRenamed("want", "shard"), shards)
        held = by_shard(asks.where("want = shard"), shards)
        ratio = [min(1.0, max(0.0, capacity - h) / m) if m else 0.0 for h, m in zip(held, moves, strict=True)]
        go = F.when(F.col("large"), unit("u", F.lit(-turn))).otherwise(unit("hub", F.lit(-turn))) < pick(ratio, F.col("want"))
        state = asks.withColumn("shard", F.when(go, F.col("want")).otherwise(F.col("shard"))).drop("want", "large")
        kept.append(asks)
        if not any(moves):
            break
    settled = stash(rest.unionByName(state), "settled")
    unstash(nodes, *kept)
    return settled


def level(nodes: DataFrame, shards: int, total: int) -> DataFrame:
    """Moves what shards have too many, documents without links first, to those with too few; counts differ by one at most."""
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = [n - q for n, q in zip(by_shard(nodes, shards), quota, strict=True)]
    surplus, lack = [max(0, x) for x in over], [max(0, -x) for x in over]
    start, bounds = [0, *accumulate(surplus)][:-1], list(accumulate(lack))
    numbered = ranked(nodes, "shard", F.col("linked"), total)
    target = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda end: end <= pick(start, F.col("shard")) + F.col("rank")))
    return numbered.withColumn("shard", F.when(F.col("rank") < pick(surplus, F.col("shard")), target).otherwise(F.col("shard"))).drop("rank")


def shard(nodes: DataFrame, shards: int = SHARDS, turns: int = TURNS) -> DataFrame:
    """nodes with doc_id and hub -> all their columns, shard, and slot, gapless from 0 in each shard."""
    columns = nodes.columns
    start = nodes.withColumn("u", unit("doc_id", "hub")).withColumn("salt", F.floor(unit("u", F.lit(1)) * SALTS).cast("int")).withColumn("shard", F.floor(unit("u", F.lit(2)) * shards).cast("int"))
    start = stash(start, "start")
    total = start.count()
    even = stash(level(propagate(start, shards, turns, total), shards, total), "even")
    return ranked(even, "shard", F.lit(0), total).select(*columns, "shard", F.col("rank").cast("long").alias("slot"))
