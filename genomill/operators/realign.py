"""Alignments made along trees, a merge a row; and realigned along another tree, where only what differs is made again.

A tree's nodes are rows (group, node, left, right, level, shape, members): the left branch is the one with the least leaf, a
shape is the hash of all below, and members are the seq_ids in the order in which they are merged. All merges of a level
are one plan, so an alignment is spread over tasks; a task holds one merge at a time. Where two trees share a subtree, its
rows are cut out of the old alignment, without the columns that hold only gaps: progressive merges add nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.operators.dp import Profile, global_path, path_rows
from genomill.operators.refine import bare_columns
from genomill.operators.trees import Tree, kmer_distance_matrix, upgma
from genomill.sources.scratch import stash

MEMBERS = "array<struct<seq_id: bigint, weight: double, seq: string>>"


def node_rows(ids: list[int], tree: Tree) -> list[tuple]:
    """(node, left, right, level, shape, members) of every node; leaves are level 0, their branches -1."""
    rows = [(i, -1, -1, 0, str(x), [x]) for i, x in enumerate(ids)]
    for k, pair in enumerate(tree.children):
        left, right = sorted((rows[c] for c in pair), key=lambda r: min(r[5]))
        shape = hashlib.md5(f"({left[4]},{right[4]})".encode()).hexdigest()
        rows.append((tree.n + k, left[0], right[0], 1 + max(left[3], right[3]), shape, left[5] + right[5]))
    return rows


def kmer_tree(seqs: list[str]) -> Tree:
    return upgma(kmer_distance_matrix([s.replace("-", "") for s in seqs]))


def identity_tree(rows: list[str]) -> Tree:
    """From the share of unequal letters where two rows of an alignment both have one; 1 where they never do."""
    a = np.array([list(r) for r in rows]) if rows else np.zeros((0, 0), str)
    d = np.zeros((len(rows), len(rows)))
    for i in range(len(rows)):
        both = (a[i] != "-") & (a[i + 1 :] != "-")
        n = both.sum(axis=1)
        d[i, i + 1 :] = d[i + 1 :, i] = np.where(n, 1 - ((a[i] == a[i + 1 :]) & both).sum(axis=1) / np.maximum(n, 1), 1.0)
    return upgma(d)


def tree_nodes(rows: DataFrame, tree: Callable[[list[str]], Tree], group: str = "set_id") -> DataFrame:
    """The nodes of each group's tree over its rows (group, seq_id, seq) that aren't empty; one group a call, as its distances are a matrix."""
    some = rows.where(F.replace(F.col("seq"), F.lit("-"), F.lit("")) != "")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        found = node_rows(pdf["seq_id"].tolist(), tree(pdf["seq"].tolist()))
        return pd.DataFrame([(key[0], *r) for r in found], columns=[group, "node", "left", "right", "level", "shape", "members"])

    kind = some.schema[group].dataType.simpleString()
    return some.select(group, "seq_id", "seq").groupBy(group).applyInPandas(run, f"{group} {kind}, node long, left long, right long, level long, shape string, members array<long>")


def _bare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for members in pdf["rows"]:
            seqs = bare_columns([m["seq"] for m in members])
            out.append([dict(m, seq=s) for m, s in zip(members, seqs, strict=True)])
        yield pdf.assign(rows=out)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for left, right in zip(pdf["a"], pdf["b"], strict=True):
            one, two = [m["seq"] for m in left], [m["seq"] for m in right]
            path = global_path(Profile(one, np.array([m["weight"] for m in left])), Profile(two, np.array([m["weight"] for m in right])))
            out.append([dict(m, seq=s) for m, s in zip([*left, *right], path_rows(path, one, two), strict=True)])
        yield pdf.drop(columns=["a", "b"]).assign(rows=out)


def parts_of(aln: DataFrame, nodes: DataFrame, group: str = "set_id") -> DataFrame:
    """group, node, rows: what an alignment (group, seq_id, weight, seq) says of each node's members, without columns of gaps."""
    each = nodes.select(group, "node", F.posexplode("members").alias("place", "seq_id")).join(aln.select(group, "seq_id", "weight", "seq"), [group, "seq_id"])
    own = F.array_sort(F.collect_list(F.struct("place", "seq_id", "weight", "seq")))
    rows = each.groupBy(group, "node").agg(F.transform(own, lambda r: F.struct(r["seq_id"].alias("seq_id"), r["weight"].alias("weight"), r["seq"].alias("seq"))).alias("rows"))
    return rows.mapInPandas(_bare, f"{group} {nodes.schema[group].dataType.simpleString()}, node long, rows {MEMBERS}")


def merge_up(nodes: DataFrame, done: DataFrame, group: str = "set_id") -> DataFrame:
    """group, node, rows of the roots: `nodes` are merged level by level from the parts that are done; each level is written."""
    kind = nodes.schema[group].dataType.simpleString()
    done = stash(done, "merged")
    for (level,) in sorted(nodes.select("level").distinct().collect()):  # as many as the tree is high
        now = nodes.where(F.col("level") == level)
        side = lambda x, name: done.select(group, F.col("node").alias(x), F.col("rows").alias(name))
        fresh = now.select(group, "node", "left", "right").join(side("left", "a"), [group, "left"]).join(side("right", "b"), [group, "right"]).select(group, "node", "a", "b")
        used = now.select(group, F.explode(F.array("left", "right")).alias("node"))
        done = stash(done.join(used, [group, "node"], "left_anti").unionByName(fresh.mapInPandas(_merged, f"{group} {kind}, node long, rows {MEMBERS}")), "merged")
    return done


def _whole(rows: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """The aligned rows; a row without letters becomes all gaps, of no columns where its whole group has none."""
    flat = roots.select(group, F.size(F.col("rows")).alias("_n"), F.length(F.col("rows")[0]["seq"]).alias("width"), F.explode("rows").alias("r")).select(group, "width", F.col("r.seq_id").alias("seq_id"), F.col("r.seq").alias("seq"))
    widths = flat.groupBy(group).agg(F.max("width").alias("width"))
    own = rows.select(group, "seq_id").join(flat.drop("width"), [group, "seq_id"], "left").join(widths, group, "left")
    return own.select(group, "seq_id", F.coalesce("seq", F.repeat(F.lit("-"), F.coalesce("width", F.lit(0)))).alias("seq"))


def _weighted(rows: DataFrame) -> DataFrame:
    return rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))


def aligned_along(rows: DataFrame, nodes: DataFrame, group: str = "set_id") -> DataFrame:
    """group, seq_id, seq: rows (group, seq_id, seq, perhaps weight) aligned along the trees; seq_ids are distinct in a group."""
    leaves, inner = nodes.where("level = 0"), nodes.where("level > 0")
    bare = _weighted(rows).withColumn("seq", F.replace(F.col("seq"), F.lit("-"), F.lit("")))
    return _whole(rows, merge_up(inner, parts_of(bare, leaves, group), group), group)


def differing(old: DataFrame, new: DataFrame, group: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """Of the new trees: nodes whose subtree the old ones lack, and the topmost nodes that they share."""
    was = old.select(group, "shape").distinct()
    fresh = new.join(was, [group, "shape"], "left_anti")
    shared = new.join(was, [group, "shape"], "left_semi")
    inside = shared.select(group, F.explode(F.array("left", "right")).alias("node"))
    return fresh, shared.join(inside, [group, "node"], "left_anti")


def realigned(aln: DataFrame, old: DataFrame, new: DataFrame, group: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """The rows of `aln` (made along `old`) aligned along `new`, and the merges made: equal to a full run along `new`, but shared subtrees aren't merged again."""
    fresh, tops = differing(old, new, group)
    fresh = stash(fresh, "fresh")
    return _whole(aln, merge_up(fresh, parts_of(_weighted(aln), tops, group), group), group), fresh


def three_way(tree: Tree) -> dict[int, float]:
    """Gotoh's weight of the edge above every node but the root; the root is taken out, so the edges of its branches are one and weigh alike.

    An edge's long length is its own and, behind it, that of the two next edges side by side. Where three edges meet, one
    of long length a weighs sqrt(b c (a + b) (a + c) / (a (b + c) (a b + b c + c a))) against the other two; an edge between two
    such places weighs the product of both. Lengths below 0 count as 0; where the divisor is below 0.001 the weight is 1.
    """
    if tree.n < 2:
        return {}
    beside = lambda x, y: x * y / (x + y) if x + y else 0.0
    length = {v: max(w, 0.0) for v, w in tree.length.items()}
    children = {tree.n + k: pair for k, pair in enumerate(tree.children)}
    down, up = {}, {}
    for v in range(tree.root):
        down[v] = length[v] + (beside(*(down[c] for c in children[v])) if v in children else 0.0)
    sister = {c: pair[1 - i] for pair in tree.children for i, c in enumerate(pair)}
    above = tree.parent()
    for v in range(tree.root - 1, -1, -1):
        up[v] = length[v] + (down[sister[v]] if above[v] == tree.root else beside(down[sister[v]], up[above[v]]))

    def weight(a: float, b: float, c: float) -> float:
        y = a * (b + c) * (a * b + b * c + c * a)
        return 1.0 if y < 0.001 else float(np.sqrt(b * c * (a + b) * (a + c) / y))

    out = {}
    for v in range(tree.root):
        low = weight(up[v], *(down[c] for c in children[v])) if v in children else 1.0
        if above[v] != tree.root:
            high = weight(down[v], down[sister[v]], up[above[v]])
        else:
            s = sister[v]
            high = weight(length[s] + down[v], *(down[c] for c in children[s])) if s in children else 1.0
        out[v] = low * high
    return out


def three_way_weights(tree: Tree) -> np.ndarray:
    """Weights of the leaves, in sum 1: the product of the edges from the root's edge down to each."""
    edges, total = three_way(tree), np.ones(tree.root + 1)
    for k in range(len(tree.children) - 1, -1, -1):
        v = tree.n + k
        for c in tree.children[k]:
            total[c] = total[v] * (1.0 if v == tree.root and c >= tree.n else edges[c])
    own = total[: tree.n]
    return own / own.sum() if tree.n else own


def weights_by_tree(rows: DataFrame, tree: Callable[[list[str]], Tree], weights: Callable[[Tree], np.ndarray], group: str = "set_id") -> DataFrame:
    """group, seq_id, weight of the rows (group, seq_id, seq) by their group's tree."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_id")
        return pdf[[group, "seq_id"]].assign(weight=weights(tree(pdf["seq"].tolist())))

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "seq_id", "seq").groupBy(group).applyInPandas(run, f"{group} {kind}, seq_id long, weight double")
