"""Alignments and trees of small sets (one Arrow call a set), and tree algebra in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.operators.dp import PartialOrder, align_pair, local_score
from genomill.operators.matches import compatible
from genomill.operators.rooting import upward
from genomill.operators.trees import Tree, kmer_distance_matrix, leaf_weights, midpoint, multiple_alignment, neighbour_joining, upgma
from genomill.plans.registry import load, query
from genomill.sources.scratch import spread
from genomill.sources.sequences import short_seqs

ROWS = "set_id long, seq_id long, seq string"


def per_set(s: DataFrame, f, schema: str) -> DataFrame:
    """f(sorted ids, sequences) -> rows without set_id, for each set."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq_id", "seq"])
        out = f(rows["seq_id"].tolist(), rows["seq"].tolist())
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in out], columns=names)

    return s.groupBy("set_id").applyInPandas(run, schema)


def aligned(s: DataFrame) -> DataFrame:
    return per_set(s, lambda ids, seqs: zip(ids, multiple_alignment(seqs), strict=True), ROWS)


@query()
def msa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple alignments of the sets of short sequences."""
    return aligned(short_seqs(spark, sf_dir))


@query()
def nw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence against the first of its set, globally."""
    return per_set(short_seqs(spark, sf_dir), lambda ids, seqs: [(i, ids[0], *align_pair(seqs[0], s)) for i, s in zip(ids[1:], seqs[1:], strict=True)], "set_id long, seq_id long, ref_id long, ref_row string, row string")


@query()
def sw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence against the first of its set, locally."""
    return per_set(short_seqs(spark, sf_dir), lambda ids, seqs: [(i, ids[0], *local_score(seqs[0], s)) for i, s in zip(ids[1:], seqs[1:], strict=True)], "set_id long, seq_id long, ref_id long, score double, ref_end long, seq_end long")


def _poa(ids: list, seqs: list[str]):
    graph = PartialOrder()
    for s in seqs:
        graph.add(s)
    return zip(ids, graph.rows(), strict=True)


@query()
def poa_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-order alignments of the sets, as insertions between merged blocks are aligned."""
    return per_set(short_seqs(spark, sf_dir), _poa, ROWS)


def tree_rows(tree: Tree, ids: list) -> list[tuple]:
    up = tree.parent()
    return [(v, up.get(v, -1), ids[v] if v < tree.n else -1, round(tree.height[v], 6), round(tree.length.get(v, 0.0), 6)) for v in range(tree.root + 1)]


NODES = "set_id long, node long, parent long, seq_id long, height double, length double"


@query()
def upgma_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_set(short_seqs(spark, sf_dir), lambda ids, seqs: tree_rows(upgma(kmer_distance_matrix(seqs)), ids), NODES)


@query()
def tree_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_set(short_seqs(spark, sf_dir), lambda ids, seqs: zip(ids, map(float, leaf_weights(upgma(kmer_distance_matrix(seqs)))), strict=True), "set_id long, seq_id long, weight double")


def _joined(ids: list, seqs: list[str]):
    edges = neighbour_joining(kmer_distance_matrix(seqs))
    u, v, at = midpoint(edges, len(ids)) if edges else (-1, -1, 0.0)
    return [(a, b, round(float(w), 6), (a, b) in ((u, v), (v, u)), round(float(at if a == u else w - at), 6) if (a, b) in ((u, v), (v, u)) else None) for a, b, w in edges]


@query()
def nj_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the neighbour-joining tree; the one that holds the midpoint of the longest path is marked."""
    return per_set(short_seqs(spark, sf_dir), _joined, "set_id long, node long, other long, length double, has_root boolean, root_at double")


def _snp_tree(ids: list, seqs: list[str]):
    chars = np.frombuffer("".join(seqs).encode(), np.uint8).reshape(len(seqs), -1)
    d = np.array([(chars != a).sum(1) for a in chars], float)
    tree = upgma(d, "avg")
    return [(tree.newick([str(i) for i in ids]), tree.n)]


@query()
def snp_distance_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Newick tree of each set from the differences at its core SNPs: an average-linkage estimate instead of likelihood."""
    from genomill.plans.alignments import snp_matrix

    return per_set(spread(snp_matrix(spark, sf_dir).withColumnRenamed("snps", "seq"), "set_id", of=load(spark, sf_dir, "conversations"), heavy=True), _snp_tree, "set_id long, newick string, leaves long")


TREE_SQL = """
leafs AS (SELECT c_custkey, c_nationkey, abs(c_acctbal) / 1000 AS len FROM customer),
nat AS (SELECT n_nationkey, n_regionkey, 1.0 + n_nationkey % 5 AS len, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS below FROM nation),
reg AS (SELECT r_regionkey, 2.0 + r_regionkey AS len, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS below FROM region)
"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, parent, length, leaf: customers under nations under regions under a root."""
    t = lambda n: load(spark, sf_dir, n)
    region = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit("root").alias("parent"), (F.lit(2.0) + F.col("r_regionkey")).alias("length"), F.lit(False).alias("leaf"))
    nation = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), (F.lit(1.0) + F.col("n_nationkey") % 5).alias("length"), F.lit(False).alias("leaf"))
    customer = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), (F.abs("c_acctbal") / 1000).alias("length"), F.lit(True).alias("leaf"))
    return region.unionByName(nation).unionByName(customer)


def ancestors(tree: DataFrame, spark: SparkSession) -> DataFrame:
    """leaf, node, length, depth: every edge above every leaf."""
    return upward(tree)


@query(f"""
WITH {TREE_SQL} SELECT 'c' || c_custkey AS leaf, round(l.len + nat.len + reg.len, 6) AS root_distance, 3 AS depth
FROM leafs l JOIN nat ON c_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey
""")
def tree_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestors(hierarchy(spark, sf_dir), spark).groupBy("leaf").agg(F.round(F.sum("length"), 6).alias("root_distance"), F.max("depth").alias("depth"))


@query(f"""
WITH {TREE_SQL}, w AS (SELECT c_custkey, l.len + nat.len / nat.below + reg.len / reg.below AS raw FROM leafs l JOIN nat ON c_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey),
f AS (SELECT c_custkey, CASE WHEN raw < 0.0001 THEN 1.0 ELSE raw END AS raw FROM w)
SELECT 'c' || c_custkey AS leaf, round(raw / sum(raw) OVER (), 9) AS weight FROM f
""")
def clustalw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = ancestors(hierarchy(spark, sf_dir), spark)
    below = up.groupBy("node").agg(F.count("*").alias("below"))
    raw = up.join(below, "node").groupBy("leaf").agg(F.sum(F.col("length") / F.col("below")).alias("raw")).withColumn("raw", F.when(F.col("raw") < 0.0001, 1.0).otherwise(F.col("raw")))
    total = raw.groupBy(F.lit(0).alias("tree")).agg(F.sum("raw").alias("total"))  # one row a tree
    return raw.withColumn("tree", F.lit(0)).join(F.broadcast(total), "tree").select("leaf", F.round(F.col("raw") / F.col("total"), 9).alias("weight"))


@query("""
WITH a AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS leafs FROM nation GROUP BY n_regionkey), b AS (SELECT n_nationkey % 5 AS k, list_sort(list(n_nationkey)) AS leafs FROM nation GROUP BY k)
SELECT a.n_regionkey AS node_a, b.k AS node_b FROM a JOIN b ON a.leafs = b.leafs
""")
def tree_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees that two trees share, joined by their sets of leaves."""
    n = load(spark, sf_dir, "nation")
    sets = lambda key, name: n.groupBy(key.alias(name)).agg(F.sort_array(F.collect_set("n_nationkey")).alias("leafs"))
    return sets(F.col("n_regionkey"), "node_a").join(sets(F.col("n_nationkey") % 5, "node_b"), "leafs").select("node_a", "node_b")


@query("""
WITH p AS (SELECT l_orderkey AS id, l_linenumber AS pa, l_linenumber + l_partkey % 2 AS pb FROM lineitem), q AS (SELECT l_orderkey AS id, l_linenumber AS pa, l_linenumber + l_suppkey % 2 AS pb FROM lineitem)
SELECT id, pa, pb FROM (SELECT id, pa, pb FROM p EXCEPT SELECT id, pa, pb FROM q)
""")
def path_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of one set of paths that the other lacks."""
    t = load(spark, sf_dir, "lineitem")
    edges = lambda c: t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pa"), (F.col("l_linenumber") + F.col(c) % 2).alias("pb"))
    return edges("l_partkey").subtract(edges("l_suppkey"))


@query("""
WITH d AS (SELECT l_suppkey AS grp, CAST(l_orderkey AS BIGINT) AS a, CAST(l_orderkey + l_partkey % 7 AS BIGINT) AS b, CAST(l_quantity AS BIGINT) AS len, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
bad AS (SELECT x.grp, x.i AS i1, y.i AS i2, x.len AS len1, y.len AS len2 FROM d x JOIN d y ON x.grp = y.grp AND x.i < y.i
        WHERE NOT (x.a - x.b = y.a - y.b AND least(x.a + x.len, y.a + y.len) > greatest(x.a, y.a)) AND NOT (least(x.a + x.len, y.a + y.len) <= greatest(x.a, y.a) AND least(x.b + x.len, y.b + y.len) <= greatest(x.b, y.b))),
gone AS (SELECT grp, i2 AS i FROM bad WHERE NOT len2 > 4 * len1 UNION SELECT grp, i1 FROM bad WHERE NOT len1 > 4 * len2),
kept AS (SELECT * FROM d ANTI JOIN gone USING (grp, i)),
far AS (SELECT *, coalesce(max(b) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM kept)
SELECT grp, i, a, b, len FROM far x WHERE b > before AND NOT EXISTS (SELECT 1 FROM kept y WHERE y.grp = x.grp AND y.i > x.i AND y.b > x.before AND y.b <= x.b)
""")
def compatible_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    d = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), rn.cast("long").alias("i"), F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_partkey") % 7).alias("b"), F.col("l_quantity").cast("long").alias("len"))
    return compatible(d, "grp")
