"""Sketch distances, block alignment and extension, vector statistics, and operations on whole alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.operators import columns as C
from genomill.operators.distances import kmer_distances, sketches
from genomill.operators.extension import block_alignment, extend_block
from genomill.operators.trees import kmer_distance_matrix, upgma
from genomill.plans.alignments import ALN, COLS, aln
from genomill.plans.registry import load, query
from genomill.plans.sequences import KMER_SQL
from genomill.plans.trees import ROWS, per_set
from genomill.sources.scratch import spread, stash
from genomill.sources.sequences import SEQS_SQL, TURNS_SQL, bounded, references, seqs, short_seqs, turns

SKETCH, K = 200, 8
MASH = f"""
s AS ({SEQS_SQL}), h AS (SELECT DISTINCT seq_id, set_id, md5(substr(seq, unnest(range(1, length(seq) - {K} + 2)), {K})) AS h FROM s WHERE length(seq) >= {K}),
r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY h) AS rn FROM h), k AS (SELECT seq_id, set_id, list(h ORDER BY h) AS sk FROM r WHERE rn <= {SKETCH} GROUP BY ALL),
p AS (SELECT x.seq_id AS a, y.seq_id AS b, list_sort(list_distinct(x.sk || y.sk))[:{SKETCH}] AS u, x.sk AS xs, y.sk AS ys FROM k x JOIN k y ON x.set_id = y.set_id AND y.seq_id < x.seq_id),
j AS (SELECT a, b, CAST(len(list_intersect(list_intersect(u, xs), ys)) AS DOUBLE) / len(u) AS j FROM p),
d AS (SELECT a, b, j, CASE WHEN j = 0 THEN 1.0 ELSE -ln(2 * j / (1 + j)) / {K} END AS d FROM j)
"""


def sketch_pairs(both: DataFrame, keep: list[str], size: int = SKETCH, k: int = K) -> DataFrame:
    """Adds j and d to pairs of sketches xs, ys: likeness among the `size` least hashes of both, and the distance it stands for."""
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("xs", "ys")), 1, size))
    j = F.size(F.array_intersect(F.array_intersect("u", "xs"), F.col("ys"))) / F.size("u")
    return both.select(*keep, j.alias("j")).withColumn("d", F.when(F.col("j") == 0, 1.0).otherwise(-F.log(2 * F.col("j") / (1 + F.col("j"))) / k))


def sketch_distances(s: DataFrame, size: int = SKETCH, k: int = K) -> DataFrame:
    """set_id, a, b, j, d for each pair of a set, from bottom sketches: the `size` least hashes of a sequence's k-mers."""
    own = stash(sketches(s, ["set_id", "seq_id"], k, size), "sketches")  # made once for both sides
    x, y = own.select("set_id", F.col("seq_id").alias("a"), F.col("sk").alias("xs")), own.select("set_id", F.col("seq_id").alias("b"), F.col("sk").alias("ys"))
    return sketch_pairs(x.join(y, "set_id").where("b < a"), ["set_id", "a", "b"], size, k)


@query(f"WITH {MASH} SELECT a, b, round(j, 6) AS j, round(d, 6) + 0.0 AS d FROM d")
def mash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_distances(seqs(spark, sf_dir)).select("a", "b", F.round("j", 6).alias("j"), (F.round("d", 6) + 0.0).alias("d"))


@query(f"""
WITH {MASH.split("p AS (")[0]} f AS (SELECT lang, min(seq_id) AS ref_id FROM s GROUP BY lang), rk AS (SELECT f.lang, f.ref_id, k.sk FROM f JOIN k ON k.seq_id = f.ref_id),
p AS (SELECT x.seq_id, rk.ref_id, list_sort(list_distinct(x.sk || rk.sk))[:{SKETCH}] AS u, x.sk AS xs, rk.sk AS ys FROM k x JOIN s ON s.seq_id = x.seq_id JOIN rk ON rk.lang = s.lang WHERE x.seq_id <> rk.ref_id),
j AS (SELECT seq_id, ref_id, CAST(len(list_intersect(list_intersect(u, xs), ys)) AS DOUBLE) / len(u) AS j FROM p),
d AS (SELECT seq_id, ref_id, CASE WHEN j = 0 THEN 1.0 ELSE -ln(2 * j / (1 + j)) / {K} END AS d FROM j)
SELECT seq_id, ref_id, round(d, 6) + 0.0 AS d FROM d WHERE d <= 0.1
""")
def mash_recruit(spark: SparkSession, sf_dir: str, most: float = 0.1) -> DataFrame:
    """Sequences within a sketch distance of their language's reference: every sequence is held against one."""
    s = seqs(spark, sf_dir)
    own = sketches(spread(s, "seq_id", heavy=True), ["seq_id", "lang"], K, SKETCH)
    refs = sketches(references(s).withColumnsRenamed({"ref_seq": "seq"}), ["lang", "ref_id"], K, SKETCH).withColumnRenamed("sk", "ys")
    both = own.withColumnRenamed("sk", "xs").join(bounded(refs), "lang").where("seq_id <> ref_id")
    return sketch_pairs(both, ["seq_id", "ref_id"]).where(F.col("d") <= most).select("seq_id", "ref_id", (F.round("d", 6) + 0.0).alias("d"))


@query(f"""
WITH s AS (SELECT seq_id, set_id, replace(words, ' ', '') AS seq FROM ({TURNS_SQL})), {KMER_SQL.format(k=4)},
shared AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(least(x.n, y.n)) AS c FROM k x JOIN k y ON x.set_id = y.set_id AND x.kmer = y.kmer AND y.seq_id < x.seq_id GROUP BY 1, 2),
d AS (SELECT x.set_id, x.seq_id AS a, y.seq_id AS b, CASE WHEN least(length(x.seq), length(y.seq)) < 4 THEN 1.0 ELSE 1 - CAST(coalesce(h.c, 0) AS DOUBLE) / (least(length(x.seq), length(y.seq)) - 3) END AS d
      FROM s x JOIN s y ON x.set_id = y.set_id AND y.seq_id < x.seq_id LEFT JOIN shared h ON h.a = x.seq_id AND h.b = y.seq_id)
SELECT set_id, a, count(*) AS n, string_agg(CAST(CAST(floor(d * 1000000 + 0.513) AS BIGINT) AS VARCHAR), ' ' ORDER BY b) AS distances FROM d GROUP BY set_id, a
""")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-triangular matrices of sets of any size, a line of distances in millionths for each sequence."""
    s = turns(spark, sf_dir).withColumn("seq", F.array_join("words", ""))
    d = kmer_distances(s, 4, fraction=True).groupBy("set_id", "a").agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("row"))
    return d.select("set_id", "a", F.size("row").cast("long").alias("n"), F.array_join(F.transform("row", lambda x: F.floor(x["d"] * 1000000 + 0.513).cast("string")), " ").alias("distances"))


@query("""
WITH q AS (SELECT l_suppkey AS grp, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS mean_rank, x / sum(x) OVER (PARTITION BY grp) AS share FROM q)
SELECT grp, round(corr(x, y), 6) AS corr, round(CAST(sum(mean_rank) AS DOUBLE), 3) AS ranks, round(sum(share), 6) AS total, round(max(share), 6) AS most FROM r GROUP BY grp
""")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, mean ranks of ties, and shares of a group's sum."""
    q = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    w = Window.partitionBy("grp")
    r = q.withColumn("mean_rank", F.rank().over(w.orderBy("x")) + (F.count("*").over(Window.partitionBy("grp", "x")) - 1) / 2.0).withColumn("share", F.col("x") / F.sum("x").over(w))
    return r.groupBy("grp").agg(F.round(F.corr("x", "y"), 6).alias("corr"), F.round(F.sum("mean_rank"), 3).alias("ranks"), F.round(F.sum("share"), 6).alias("total"), F.round(F.max("share"), 6).alias("most"))


@query(f"""
WITH {COLS}, bad AS (SELECT DISTINCT set_id, col FROM c WHERE ch = '-')
SELECT c.set_id, c.seq_id, string_agg(c.ch, '' ORDER BY c.col) AS seq FROM c ANTI JOIN bad ON bad.set_id = c.set_id AND bad.col = c.col GROUP BY c.set_id, c.seq_id
""")
def gapless_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments without the columns that hold a gap."""
    a = aln(spark, sf_dir)
    whole = C.at_columns(a, lambda n: n["n_gap"] == 0)
    return C.letters_at(whole).select("set_id", "seq_id", F.col("letters").alias("seq"))


@query(f"""
WITH {ALN} SELECT seq_id % 100 AS place, string_agg(seq, '' ORDER BY set_id) AS seq FROM aln GROUP BY place
""")
def concatenated_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of several sets side by side: rows with one place in their sets are joined."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("set_id", "seq"))), lambda x: x["seq"])
    return aln(spark, sf_dir).groupBy((F.col("seq_id") % 100).alias("place")).agg(F.array_join(parts, "").alias("seq"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short_seqs(spark, sf_dir).withColumns({"set_id": F.floor(F.col("seq_id") / 3), "seq": F.replace(F.col("seq"), F.lit("N"), F.lit(""))})


@query()
def block_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of three aligned between their anchors; anchors in lower case."""
    return per_set(triples(spark, sf_dir), lambda ids, seqs: zip(ids, block_alignment(seqs), strict=True), ROWS)


@query()
def extended_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the first 50 bases of each set of three, as far as it can be aligned without long indels."""
    return per_set(triples(spark, sf_dir), lambda ids, seqs: zip(ids, extend_block([s[50:] for s in seqs]), strict=True), ROWS)


def _height_clusters(ids: list, seqs: list[str], most: float = 1.25):
    tree = upgma(kmer_distance_matrix(seqs))
    roots, stack = [], [tree.root]
    while stack:
        v = stack.pop()
        if v < tree.n or tree.height[v] <= most:
            roots.append(v)
        else:
            stack += tree.children[v - tree.n]
    return sorted((ids[leaf], min(ids[x] for x in tree.leaves(v))) for v in roots for leaf in tree.leaves(v))


@query()
def tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtrees below a height, named by their first sequence."""
    return per_set(short_seqs(spark, sf_dir), _height_clusters, "set_id long, seq_id long, cluster long")
