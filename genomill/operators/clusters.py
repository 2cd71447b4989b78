"""Weights of rows from how alike they are: linked clusters, and shares down a cluster tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genomill.operators.trees import Tree, upgma
from genomill.sources.scratch import stash


def linked_clusters(rows: DataFrame, near: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, cluster (its least seq_id), weight (1 / size), effective (clusters of the group): rows (group, seq_id) linked by pairs near (group, a, b).

    Labels are passed on along the links until none changes; a row without links is a cluster.
    """
    both = stash(near.select(group, F.col("a").alias("x"), F.col("b").alias("y")).unionByName(near.select(group, F.col("b").alias("x"), F.col("a").alias("y"))), "links")
    label = stash(rows.select(group, "seq_id", F.col("seq_id").alias("cluster")), "labels")
    while True:
        heard = both.join(label.select(group, F.col("seq_id").alias("y"), "cluster"), [group, "y"]).groupBy(group, F.col("x").alias("seq_id")).agg(F.min("cluster").alias("heard"))
        told = label.join(heard, [group, "seq_id"], "left").select(group, "seq_id", F.col("cluster").alias("old"), F.least("cluster", "heard").alias("cluster"))
        short = told.select(group, F.col("seq_id").alias("cluster"), F.col("cluster").alias("further"))  # a label's own label
        label = stash(told.join(short, [group, "cluster"], "left").select(group, "seq_id", "old", F.least("cluster", "further").alias("cluster")), "labels")
        if label.where("old <> cluster").isEmpty():
            break
        label = label.drop("old")
    own = Window.partitionBy(group)
    sized = label.drop("old").withColumn("weight", 1 / F.count("*").over(Window.partitionBy(group, "cluster")))
    return sized.withColumn("effective", F.sum((F.col("seq_id") == F.col("cluster")).cast("int")).over(own))


def shares(tree: Tree) -> np.ndarray:
    """Weights of the leaves: a node hands its own on to its branches by the sum of the merge distances below each and its own.

    Where nothing is merged at a distance, branches are weighed by their leaves.
    """
    merged = [2 * h for h in tree.height]
    inside = [0.0] * (tree.root + 1)
    for i, (a, b) in enumerate(tree.children):
        inside[tree.n + i] = merged[tree.n + i] + inside[a] + inside[b]
    weight = [0.0] * (tree.root + 1)
    weight[tree.root] = 1.0
    for i in range(len(tree.children) - 1, -1, -1):
        v = tree.n + i
        for c in tree.children[i]:
            part = (inside[c] + merged[v]) / (inside[v] + merged[v]) if inside[v] else len(tree.leaves(c)) / len(tree.leaves(v))
            weight[c] = weight[v] * part
    return np.array(weight[: tree.n])


def gsc_weights(rows: DataFrame, pairs: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, weight: shares down the single-linkage tree of 1 - identity; pairs: group, a, b, identity. Pairs without a common column are at distance 1."""
    near = pairs.groupBy(group).agg(F.collect_list(F.struct("a", "b", "identity")).alias("pairs"))
    sets = rows.groupBy(group).agg(F.array_sort(F.collect_list("seq_id")).alias("ids")).join(near, group, "left")

    def run(batches):
        for pdf in batches:
            out = []
            for set_id, ids, pairs_ in zip(pdf[group], pdf["ids"], pdf["pairs"], strict=True):
                at, d = {x: i for i, x in enumerate(ids)}, np.ones((len(ids), len(ids)))
                for p in pairs_ if pairs_ is not None else ():
                    d[at[p["a"]], at[p["b"]]] = d[at[p["b"]], at[p["a"]]] = 1 - p["identity"]
                out += [(set_id, x, w) for x, w in zip(ids, shares(upgma(d, "min")), strict=True)]
            yield pd.DataFrame(out, columns=[group, "seq_id", "weight"]).astype({group: "int64", "seq_id": "int64", "weight": "float64"})

    return sets.mapInPandas(run, f"{group} long, seq_id long, weight double")
