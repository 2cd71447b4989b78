"""Roots, splits and pruning of the tree of regions, nations and customers; weights from clusters of alike rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import columns as C
from genomill.operators import rooting as R
from genomill.operators.clusters import gsc_weights as gsc
from genomill.operators.clusters import linked_clusters
from genomill.plans.alignments import IDENTITY, aln
from genomill.plans.registry import query
from genomill.plans.trees import TREE_SQL, hierarchy

# distances of every node to every leaf, over their lowest common node
NODES = f"""
WITH {TREE_SQL}, lf AS (SELECT 'c' || c_custkey AS leaf, 'n' || c_nationkey AS na, 'r' || n_regionkey AS re, l.len AS d1, nat.len AS d2, reg.len AS d3 FROM leafs l JOIN nat ON c_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey),
ed AS (SELECT leaf AS node, na AS parent, d1 AS length, leaf AS c, na, re, d1, d2, d3, 1 AS kind FROM lf UNION ALL SELECT DISTINCT na, re, d2, NULL, na, re, 0, d2, d3, 2 FROM lf UNION ALL SELECT DISTINCT re, 'root', d3, NULL, NULL, re, 0, 0, d3, 3 FROM lf),
ps AS (SELECT e.node, e.parent, e.length, l.leaf,
         CASE e.kind WHEN 1 THEN e.c = l.leaf WHEN 2 THEN e.na = l.na ELSE e.re = l.re END AS under,
         CASE e.kind WHEN 1 THEN 0 WHEN 2 THEN l.d1 ELSE l.d1 + l.d2 END AS down,
         CASE e.kind WHEN 1 THEN CASE WHEN e.na = l.na THEN l.d1 WHEN e.re = l.re THEN e.d2 + l.d2 + l.d1 ELSE e.d2 + e.d3 + l.d3 + l.d2 + l.d1 END
                     WHEN 2 THEN CASE WHEN e.re = l.re THEN l.d2 + l.d1 ELSE e.d3 + l.d3 + l.d2 + l.d1 END ELSE l.d3 + l.d2 + l.d1 END AS up
       FROM ed e, lf l),
ds AS (SELECT node, parent, any_value(length) AS length, count(*) FILTER (under) AS n, sum(down) FILTER (under) AS total, max(down) FILTER (under) AS most, count(*) FILTER (NOT under) AS n_up, sum(up) FILTER (NOT under) AS total_up, max(up) FILTER (NOT under) AS most_up FROM ps GROUP BY node, parent)
"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edge_distances(hierarchy(spark, sf_dir), spark)


@query(f"{NODES} SELECT node, parent, n, round(total, 4) AS total, round(most, 4) AS most, n_up, round(total_up, 4) AS total_up, round(most_up, 4) AS most_up FROM ds")
def leaf_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves on both sides of every edge, and the sum and the greatest of their distances from its ends."""
    e = edges(spark, sf_dir)
    return e.select("node", "parent", "n", F.round("total", 4).alias("total"), F.round("most", 4).alias("most"), "n_up", F.round("total_up", 4).alias("total_up"), F.round("most_up", 4).alias("most_up"))


@query(f"""
{NODES}, x AS (SELECT 'span' AS rule, *, (most_up + length - most) / 2 AS low, -(most + length + most_up) AS key FROM ds UNION ALL SELECT 'mean', *, (total_up / n_up - total / n + length) / 2 AS low, 0 FROM ds),
y AS (SELECT *, greatest(most + low, most_up + length - low) AS height FROM x WHERE low >= 0 AND low <= length),
z AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY round(CASE WHEN rule = 'span' THEN key ELSE height END, 9), node) AS rn FROM y)
SELECT rule, node, parent, round(low, 6) AS low, round(length - low, 6) AS high, round(height, 6) AS height FROM z WHERE rn = 1
""")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root by the middle of the longest span and by even mean distances to leaves."""
    return R.roots(edges(spark, sf_dir)).select("rule", "node", "parent", *(F.round(c, 6).alias(c) for c in ("low", "high", "height")))


@query(f"""
{NODES}, a AS (SELECT count(*) AS total FROM lf), sd AS (SELECT node, under, count(*) AS n, string_agg(leaf, ',' ORDER BY leaf) AS names FROM ps GROUP BY node, under),
ch AS (SELECT s.node, s.n, s.names, row_number() OVER (PARTITION BY node ORDER BY s.n, CASE WHEN under THEN 0 ELSE 1 END) AS rn FROM sd s)
SELECT node, CASE WHEN (SELECT total FROM a) = n THEN 0 ELSE n END AS n, md5(names) AS part FROM ch WHERE rn = 1
""")
def tree_bipartitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of the leaves at every edge."""
    return R.bipartitions(hierarchy(spark, sf_dir), spark)


@query(f"""
WITH {TREE_SQL}, k AS (SELECT 'c' || c_custkey AS leaf, c_nationkey AS na, n_regionkey AS re, l.len AS d1, nat.len AS d2, reg.len AS d3 FROM leafs l JOIN nat ON c_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey WHERE c_custkey % 11 = 0),
nk AS (SELECT na, count(*) AS m FROM k GROUP BY na), rk AS (SELECT re, count(DISTINCT na) AS m FROM k GROUP BY re),
j AS (SELECT k.*, nk.m > 1 AS nf, rk.m > 1 AS rf FROM k JOIN nk USING (na) JOIN rk USING (re)),
e AS (SELECT leaf AS node, CASE WHEN nf THEN 'n' || na WHEN rf THEN 'r' || re ELSE 'root' END AS parent, d1 + CASE WHEN nf THEN 0 ELSE d2 + CASE WHEN rf THEN 0 ELSE d3 END END AS length FROM j
  UNION SELECT 'n' || na, CASE WHEN rf THEN 'r' || re ELSE 'root' END, d2 + CASE WHEN rf THEN 0 ELSE d3 END FROM j WHERE nf UNION SELECT 'r' || re, 'root', d3 FROM j WHERE rf)
SELECT node, parent, round(greatest(length, 1.5), 6) AS length FROM e
""")
def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every eleventh customer, without nodes of one branch; no edge below 1.5."""
    t = hierarchy(spark, sf_dir)
    kept = t.where(F.col("leaf") & (F.substring("node", 2, 20).cast("long") % 11 == 0)).select("node")
    return R.pruned(t, kept, spark, 1.5).select("node", "parent", F.round("length", 6).alias("length"))


ALIKE = 0.36


@query(f"""
WITH RECURSIVE {IDENTITY.replace("WITH ", "")}, ln AS (SELECT set_id, a AS x, b AS y FROM pr WHERE CAST(same AS DOUBLE) / n_both > {ALIKE} UNION ALL SELECT set_id, b, a FROM pr WHERE CAST(same AS DOUBLE) / n_both > {ALIKE}),
rc(set_id, seq_id, at_id) AS (SELECT set_id, seq_id, seq_id FROM s UNION SELECT rc.set_id, rc.seq_id, ln.y FROM rc JOIN ln ON ln.x = rc.at_id),
cl AS (SELECT set_id, seq_id, min(at_id) AS cluster FROM rc GROUP BY set_id, seq_id)
SELECT set_id, seq_id, cluster, round(1.0 / count(*) OVER (PARTITION BY set_id, cluster), 9) AS weight, count(DISTINCT cluster) OVER (PARTITION BY set_id) AS effective FROM cl
""")
def cluster_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of alignments in clusters linked by identity: an equal share of 1 in each, and the number of clusters as that of truly different rows."""
    near = C.pair_identity(aln(spark, sf_dir)).where(F.col("identity") > ALIKE)
    return linked_clusters(aln(spark, sf_dir), near).withColumn("weight", F.round("weight", 9))


@query("SELECT conv_id AS set_id, count(*) AS n, 1.0::DOUBLE AS total, true AS positive FROM conversations GROUP BY conv_id")
def gsc_weight_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights down the single-linkage tree of each alignment sum to 1."""
    w = gsc_weights(spark, sf_dir)
    return w.groupBy("set_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), (F.min("weight") > 0).alias("positive"))


@query()
def gsc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's share goes to its branches by what is merged below them, from the root down to the rows."""
    return gsc(aln(spark, sf_dir), C.pair_identity(aln(spark, sf_dir)))
