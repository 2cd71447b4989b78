"""Trees as rows (node, parent, length, leaf): distances to all leaves, roots, bipartitions, pruning.

A tree has one root, the parent that is no node; a leaf's edges up to it are found level by level, and what lies above an
edge from the root down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.sources.scratch import stash


def upward(tree: DataFrame) -> DataFrame:
    """leaf, node, length, depth: every edge above every leaf, depth 1 being its own; an edge is named by its lower node.

    One join a level, written to the shared folder; a recursive query may have a million rows only.
    """
    edges = tree.select("node", "parent", "length")
    level = stash(tree.where("leaf").select(F.col("node").alias("leaf"), "node", "parent", "length", F.lit(1).alias("depth")), "upward")
    found = level
    while True:
        above = edges.select(F.col("node").alias("above"), F.col("parent").alias("further"), F.col("length").alias("step"))
        level = stash(level.join(above, level["parent"] == above["above"]).select("leaf", F.col("above").alias("node"), F.col("further").alias("parent"), F.col("step").alias("length"), (F.col("depth") + 1).alias("depth")), "upward")
        if level.isEmpty():
            return found.drop("parent")
        found = found.unionByName(level)


def below(tree: DataFrame, spark: SparkSession) -> DataFrame:
    """node, n, total, most: leaves below each node, and the sum and the greatest of their distances from it."""
    w = Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    down = upward(tree).withColumn("d", F.coalesce(F.sum("length").over(w), F.lit(0.0)))
    return down.groupBy("node").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.max("d").alias("most"))


def edge_distances(tree: DataFrame, spark: SparkSession) -> DataFrame:
    """node, parent, length, and for the leaves below the edge from its lower end (n, total, most) and all others from its upper end (n_up, total_up, most_up).

    What lies above a node's edge is what lies below its sisters and above its parent's edge: one pass up, one down.
    """
    own = tree.join(below(tree, spark), "node").select("node", "parent", "length", "n", "total", "most", (F.col("total") + F.col("n") * F.col("length")).alias("far"), (F.col("most") + F.col("length")).alias("reach"))
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("reach"), "node"))
    ranked = own.withColumn("rank", rank)
    every = ranked.groupBy("parent").agg(F.sum("n").alias("all_n"), F.sum("far").alias("all_far"), F.max("reach").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("reach"))).alias("second"))
    sisters = ranked.join(every, "parent").select("node", "parent", "length", "n", "total", "most", (F.col("all_n") - F.col("n")).alias("sn"), (F.col("all_far") - F.col("far")).alias("sf"), F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first")).alias("sm"))
    sisters = stash(sisters, "sisters")
    level = stash(sisters.join(sisters.select(F.col("node").alias("parent")), "parent", "left_anti").select(*sisters.columns).withColumnsRenamed({"sn": "n_up", "sf": "total_up", "sm": "most_up"}), "edges")
    found = level
    while True:
        d = level.select(F.col("node").alias("parent"), F.col("length").alias("d_length"), *("n_up", "total_up", "most_up"))
        met = sisters.join(d, "parent").select(
            "node", "parent", "length", "n", "total", "most", (F.col("sn") + F.col("n_up")).alias("n_up"),
            (F.col("sf") + F.col("total_up") + F.col("n_up") * F.col("d_length")).alias("total_up"), F.greatest("sm", F.col("most_up") + F.col("d_length")).alias("most_up"),
        )
        level = stash(met, "edges")
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def roots(edges: DataFrame) -> DataFrame:
    """rule, node, parent, low, high, height: where each rule puts the root: on the edge above `node`, `low` from it and `high` from its parent.

    span: the middle of the longest path between leaves. mean: where the mean distances to the leaves on both sides are
    alike; of several such edges the one with the least height. Ties go to the first node.
    """
    e = edges.where("n > 0 and n_up > 0")
    middle = (F.col("most_up") + F.col("length") - F.col("most")) / 2
    even = (F.col("total_up") / F.col("n_up") - F.col("total") / F.col("n") + F.col("length")) / 2
    span = e.withColumns({"low": middle, "key": -(F.col("most") + F.col("length") + F.col("most_up"))}).withColumn("rule", F.lit("span"))
    mean = e.withColumn("low", even).withColumn("key", F.greatest(F.col("most") + F.col("low"), F.col("most_up") + F.col("length") - F.col("low"))).withColumn("rule", F.lit("mean"))
    both = span.unionByName(mean).where((F.col("low") >= 0) & (F.col("low") <= F.col("length")))
    height = F.greatest(F.col("most") + F.col("low"), F.col("most_up") + F.col("length") - F.col("low"))
    best = F.min_by(F.struct("node", "parent", "low", (F.col("length") - F.col("low")).alias("high"), height.alias("height")), F.struct(F.round("key", 9), F.col("node")))
    return both.groupBy("rule").agg(best.alias("b")).select("rule", "b.*")


def bipartitions(tree: DataFrame, spark: SparkSession) -> DataFrame:
    """node, n, part: of every edge the leaves on its smaller side (below it, if both are alike) as the hash of their sorted names. Equal hashes in two trees of the same leaves are shared splits."""
    up = upward(tree)
    leaves = up.where("depth = 1").agg(F.count("*").alias("all"), F.array_sort(F.collect_list("leaf")).alias("names"))  # one row a tree
    own = up.groupBy("node").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("leaf")).alias("side")).withColumn("one", F.lit(1))
    both = own.join(F.broadcast(leaves.withColumn("one", F.lit(1))), "one")
    side = F.when(F.col("n") * 2 <= F.col("all"), F.col("side")).otherwise(F.array_except("names", "side"))
    return both.select("node", F.least("n", F.col("all") - F.col("n")).alias("n"), F.md5(F.array_join(side, ",").cast("binary")).alias("part"))


def pruned(tree: DataFrame, kept: DataFrame, spark: SparkSession, shortest: float = 0.0) -> DataFrame:
    """node, parent, length of the tree of the kept leaves (column node): nodes with one branch left are passed over, their edges added up; no edge is shorter than `shortest`."""
    up = upward(tree).join(kept.select(F.col("node").alias("leaf")), "leaf", "left_semi")
    parents = tree.select("node", "parent")
    used = up.select("node").distinct().join(parents, "node")
    forks = used.groupBy("parent").agg(F.count("*").alias("branches")).where("branches > 1").select(F.col("parent").alias("node"))
    tops = parents.select(F.col("parent").alias("node")).distinct().join(parents.select("node"), "node", "left_anti")
    stays = forks.union(tops).distinct()  # where an edge may end
    at = up.join(parents, "node").join(stays.select(F.col("node").alias("parent"), F.lit(1).alias("stop")), "parent", "left")
    w = Window.partitionBy("leaf").orderBy("depth")
    # an edge of the pruned tree: from a leaf or a fork up to the next stop
    run = F.coalesce(F.sum(F.coalesce("stop", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = at.withColumn("run", run).groupBy("leaf", "run").agg(F.min_by("node", "depth").alias("node"), F.max_by("parent", "depth").alias("parent"), F.sum("length").alias("length"))
    return edges.select("node", "parent", F.greatest("length", F.lit(shortest)).alias("length")).distinct()
