"""Match, chain and cluster queries. Sets of documents give exact matches; order lines stand for matches of three genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import matches as M
from genomill.plans.registry import load, query
from genomill.sources.scratch import spread
from genomill.sources.sequences import SEQS_SQL, bounded, references, seqs

BASES_SQL = f"SELECT seq_id, lang, replace(seq, 'N', '') AS seq FROM ({SEQS_SQL})"  # without the N that stand for blanks
KMERS = "(SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {t} WHERE length(seq) >= {k})"
# from the definition: equal windows in runs along a diagonal, then those whose string occurs once in each sequence
PAIRS = (
    f"s AS ({BASES_SQL}), r AS (SELECT lang, min(seq_id) AS ref_id FROM s GROUP BY lang), refs AS (SELECT r.lang, ref_id, seq FROM r JOIN s ON seq_id = ref_id), "
    "q AS (SELECT s.*, true AS fwd FROM s JOIN r ON s.lang = r.lang WHERE seq_id <> ref_id UNION ALL SELECT seq_id, s.lang, reverse(translate(seq, 'ACGTU', 'TGCAA')), false FROM s JOIN r ON s.lang = r.lang WHERE seq_id <> ref_id), "
    "kr AS (SELECT lang, ref_id, seq AS ref_seq, p, substr(seq, p, {k}) AS kmer FROM " + KMERS.replace("{t}", "refs") + "), kq AS (SELECT lang, seq_id, fwd, seq, p, substr(seq, p, {k}) AS kmer FROM " + KMERS.replace("{t}", "q") + "), "
    "seeds AS (SELECT ref_id, seq_id AS query_id, fwd, kr.p AS r, kq.p AS q, ref_seq, seq FROM kr JOIN kq ON kr.lang = kq.lang AND kr.kmer = kq.kmer), "
    "l AS (SELECT *, r - lag(r) OVER (PARTITION BY ref_id, query_id, fwd, q - r ORDER BY r) AS step FROM seeds), "
    "g AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY ref_id, query_id, fwd, q - r ORDER BY r) AS run FROM l), "
    "mem AS (SELECT ref_id, query_id, fwd, min(r) AS r, min(q) AS q, max(r) - min(r) + {k} AS length, substr(any_value(ref_seq), min(r), max(r) - min(r) + {k}) AS w FROM g GROUP BY ref_id, query_id, fwd, q - r, run), "
    "once AS (SELECT ref_id, w FROM (SELECT DISTINCT ref_id, w, length FROM mem) m JOIN kr USING (ref_id) WHERE kr.kmer = substr(w, 1, {k}) AND substr(ref_seq, p, length) = w GROUP BY ref_id, w HAVING count(*) = 1), "
    "twice AS (SELECT query_id, m.fwd, w FROM (SELECT DISTINCT query_id, fwd, w, length FROM mem) m JOIN kq ON kq.seq_id = query_id AND kq.fwd = m.fwd WHERE kq.kmer = substr(w, 1, {k}) AND substr(seq, p, length) = w GROUP BY query_id, m.fwd, w HAVING count(*) = 1), "
    "mm AS (SELECT m.ref_id, m.query_id, m.fwd, m.r - 1 AS ref_start, m.q - 1 AS query_start, m.length FROM mem m JOIN once o ON o.ref_id = m.ref_id AND o.w = m.w JOIN twice t ON t.query_id = m.query_id AND t.fwd = m.fwd AND t.w = m.w)"
)


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("seq_id", "lang", F.replace(F.col("seq"), F.lit("N"), F.lit("")).alias("seq"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with the reference of its language: ref_id, ref_seq, query_id, seq."""
    s = bases(spark, sf_dir)
    return spread(s, "seq_id", heavy=True).join(bounded(references(s)), "lang").where("seq_id <> ref_id").select("ref_id", "ref_seq", F.col("seq_id").alias("query_id"), "seq")


@query(f"WITH {PAIRS.format(k=13)} SELECT * FROM mm")
def mum_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.pair_matches(pairs(spark, sf_dir), 13)


@query(f"""
WITH s AS (SELECT seq_id // 3 AS set_id, seq_id, seq, row_number() OVER (PARTITION BY seq_id // 3 ORDER BY seq_id) AS place, count(*) OVER (PARTITION BY seq_id // 3) AS n FROM ({BASES_SQL})),
kp AS (SELECT set_id, place, n, seq, p, substr(seq, p, 10) AS kmer FROM {KMERS.format(k=10, t="s")}),
seeds AS (SELECT a.set_id, a.n, a.seq, b.seq AS seq2, c.seq AS seq3, a.p AS p1, b.p AS p2, c.p AS p3 FROM kp a JOIN kp b ON a.set_id = b.set_id AND a.kmer = b.kmer AND a.place = 1 AND b.place = 2
          LEFT JOIN kp c ON a.set_id = c.set_id AND a.kmer = c.kmer AND c.place = 3 WHERE a.n = 2 OR c.p IS NOT NULL),
l AS (SELECT *, p1 - lag(p1) OVER (PARTITION BY set_id, p2 - p1, p3 - p1 ORDER BY p1) AS step FROM seeds),
g AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY set_id, p2 - p1, p3 - p1 ORDER BY p1) AS run FROM l),
mem AS (SELECT set_id, any_value(n) AS n, min(p1) AS p1, min(p2) AS p2, min(p3) AS p3, max(p1) - min(p1) + 10 AS length, substr(any_value(seq), min(p1), max(p1) - min(p1) + 10) AS w FROM g GROUP BY set_id, p2 - p1, p3 - p1, run),
once AS (SELECT set_id, place, w FROM (SELECT DISTINCT set_id, w, length FROM mem) m JOIN kp USING (set_id) WHERE kp.kmer = substr(w, 1, 10) AND substr(seq, p, length) = w GROUP BY set_id, place, w HAVING count(*) = 1),
o AS (SELECT set_id, w, count(*) AS n FROM once GROUP BY set_id, w)
SELECT m.set_id, m.p1 - 1 AS ref_start, m.p1 - 1 + m.length AS ref_end, m.n AS n_genomes, m.p2 - 1 AS start2, m.p3 - 1 AS start3 FROM mem m JOIN o ON o.set_id = m.set_id AND o.w = m.w AND o.n = m.n
""")
def multi_mum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.multi_matches(bases(spark, sf_dir).withColumn("set_id", F.floor(F.col("seq_id") / 3)), 10)
    start = lambda i: F.get("starts", F.lit(i))
    return found.select("set_id", start(0).alias("ref_start"), (start(0) + F.col("length")).alias("ref_end"), F.size("starts").cast("long").alias("n_genomes"), start(1).alias("start2"), start(2).alias("start3"))


MUMI = (
    PAIRS.format(k=15) + ", c AS (SELECT ref_id, query_id, sum(n) AS covered, max(length) AS longest FROM (SELECT *, greatest(ref_start + length - greatest(ref_start, coalesce(max(ref_start + length) OVER (PARTITION BY ref_id, query_id ORDER BY ref_start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS n FROM mm) GROUP BY ALL), "
    "mu AS (SELECT a.lang, a.ref_id, x.seq_id AS query_id, round(CASE WHEN length(a.seq) / CAST(length(x.seq) AS DOUBLE) > 1.3 OR length(a.seq) / CAST(length(x.seq) AS DOUBLE) < 0.7 THEN 1.0 "
    "ELSE 1 - coalesce(covered - CASE WHEN longest = length(a.seq) THEN 1 ELSE 0 END, 0) / CAST(length(a.seq) AS DOUBLE) END, 6) AS mumi "
    "FROM refs a JOIN s x ON x.lang = a.lang AND x.seq_id <> a.ref_id LEFT JOIN c ON c.ref_id = a.ref_id AND c.query_id = x.seq_id)"
)


def mumi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, query_id, mumi of every sequence and its language's reference."""
    p = pairs(spark, sf_dir)
    sizes = p.select("ref_id", F.length("ref_seq").alias("ref_len"), "query_id", F.length("seq").alias("query_len"))
    return M.mumi(M.pair_matches(p, 15), sizes).withColumn("mumi", F.round("mumi", 6))


@query(f"WITH {MUMI} SELECT ref_id, query_id, mumi FROM mu")
def mumi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mumi_rows(spark, sf_dir)


@query(f"WITH {MUMI} SELECT ref_id, query_id, mumi FROM mu WHERE mumi < 0.5")
def mumi_recruit(spark: SparkSession, sf_dir: str, most: float = 0.5) -> DataFrame:
    """The genomes near enough to their reference to take part."""
    return mumi_rows(spark, sf_dir).where(F.col("mumi") < most)


@query(f"""
WITH {MUMI} SELECT ref_id, arg_min(query_id, (mumi, query_id)) AS nearest, min(mumi) AS mumi, arg_min(query_id, md5(CAST(query_id AS VARCHAR)) || CAST(query_id AS VARCHAR)) AS drawn FROM mu GROUP BY ref_id
""")
def autopick_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome of the lowest MUMi becomes the reference; beside it a reproducible draw."""
    h = F.concat(F.md5(F.col("query_id").cast("string").cast("binary")), F.col("query_id").cast("string"))
    return mumi_rows(spark, sf_dir).groupBy("ref_id").agg(F.min_by("query_id", F.struct("mumi", "query_id")).alias("nearest"), F.min("mumi").alias("mumi"), F.min_by("query_id", h).alias("drawn"))


GENOMES = 3
MATCHES = (
    "m0 AS (SELECT l_suppkey AS grp, l_orderkey, l_linenumber, l_partkey, CAST(5 + l_quantity AS BIGINT) AS length, l_orderkey * 80 + l_linenumber AS s1, l_orderkey * 80 + l_partkey % 4 AS s2, 100000000 - l_orderkey * 80 AS s3 FROM lineitem), "
    "m AS (SELECT grp, l_orderkey, l_linenumber, l_partkey, length, [s1, s2, s3] AS start, [s1 + length, s2 + length, s3 + length] AS e, [true, true, false] AS fwd FROM m0)"
)
CHAIN = (
    MATCHES + ", p AS (SELECT *, lag(start) OVER w AS ps, lag(e) OVER w AS pe FROM m WINDOW w AS (PARTITION BY grp ORDER BY start[1], l_orderkey, l_linenumber, l_partkey, length)), "
    "q AS (SELECT *, [start[1] - pe[1], start[2] - pe[2], ps[3] - e[3]] AS gaps FROM p), "
    "b AS (SELECT *, CASE WHEN ps IS NOT NULL AND list_min(gaps) >= 0 AND list_max(gaps) <= 300 AND "
    "CAST(CASE WHEN list_min(gaps) = 0 THEN 1 ELSE least(list_min(gaps), 310) END AS DOUBLE) / CASE WHEN list_max(gaps) = 0 THEN 1 ELSE list_max(gaps) END >= 1 - 0.12 THEN 0 ELSE 1 END AS breaks FROM q), "
    "ch AS (SELECT grp, l_orderkey, l_linenumber, length, start, e, fwd, CAST(sum(breaks) OVER (PARTITION BY grp ORDER BY start[1], l_orderkey, l_linenumber, l_partkey, length ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lcb FROM b), "
    "cl AS (SELECT grp, lcb, count(*) AS n_mums, CAST(sum(length) AS BIGINT) AS length, min_by(start, start[1]) AS fs, max_by(e, start[1]) AS le, min_by(e, start[1]) AS fe, max_by(start, start[1]) AS ls FROM ch GROUP BY grp, lcb), "
    "kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY lcb DESC) AS rn FROM cl) WHERE length > 21 OR rn = 1)"
)


def line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = (5 + F.col("l_quantity")).cast("long")
    starts = [F.col("l_orderkey") * 80 + F.col("l_linenumber"), F.col("l_orderkey") * 80 + F.col("l_partkey") % 4, 100000000 - F.col("l_orderkey") * 80]
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("grp"), "l_orderkey", "l_linenumber", "l_partkey", length.alias("length"), F.array(*starts).alias("start"), F.array(*(s + length for s in starts)).alias("end"), F.array(F.lit(True), F.lit(True), F.lit(False)).alias("fwd"),
    )


ORDER = ["ref_start", "l_orderkey", "l_linenumber", "l_partkey", "length"]


def line_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chained(line_matches(spark, sf_dir).withColumn("ref_start", F.col("start")[0]), "grp", ORDER, GENOMES).drop("ref_start")


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.long_clusters(M.clusters(line_chain(spark, sf_dir), "grp"), "grp")


@query(f"WITH {CHAIN} SELECT grp, l_orderkey, l_linenumber, lcb FROM ch")
def chain_lcb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chain(spark, sf_dir).select("grp", "l_orderkey", "l_linenumber", "lcb")


@query(f"WITH {CHAIN} SELECT grp, lcb, n_mums, length, fs[1] AS ref_start, le[1] AS ref_end FROM kept")
def lcb_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_clusters(spark, sf_dir).select("grp", "lcb", "n_mums", "length", F.col("first_start")[0].alias("ref_start"), F.col("last_end")[0].alias("ref_end"))


@query(f"""
WITH {CHAIN}, x AS (SELECT grp, unnest([0, 1, 2]) AS genome, unnest([abs(le[1] - fs[1]), abs(le[2] - fs[2]), abs(fe[3] - ls[3])]) AS bases FROM kept)
SELECT grp, genome, CAST(sum(bases) AS BIGINT) AS covered, count(*) AS n FROM x GROUP BY ROLLUP (grp, genome)
""")
def lcb_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage(line_clusters(spark, sf_dir), "grp", GENOMES)


@query(f"""
WITH {CHAIN}, n AS (SELECT *, lead(fs) OVER w AS ns, lead(fe) OVER w AS ne, lead(lcb) OVER w AS n_lcb FROM kept WINDOW w AS (PARTITION BY grp ORDER BY lcb)),
x AS (SELECT grp, lcb, n_lcb, [ns[1] - le[1], ns[2] - le[2], ls[3] - ne[3]] AS gaps FROM n WHERE n_lcb IS NOT NULL)
SELECT grp, lcb, n_lcb, gaps[1] AS g1, gaps[2] AS g2, gaps[3] AS g3 FROM x WHERE list_min(gaps) >= 5
""")
def intercluster_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.between_clusters(line_clusters(spark, sf_dir), "grp", GENOMES).select("grp", "lcb", "n_lcb", *(F.col("gaps")[i].alias(f"g{i + 1}") for i in range(GENOMES)))


@query(f"""
WITH {CHAIN} SELECT grp, CAST(sum(n_mums) AS BIGINT) AS n_mums, count(*) AS n_lcb, CAST(sum(n_mums) // count(*) AS BIGINT) AS mean_mums, CAST(sum(le[1] - fs[1]) // count(*) AS BIGINT) AS mean_length FROM kept GROUP BY grp
""")
def cluster_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    return line_clusters(spark, sf_dir).groupBy("grp").agg(F.sum("n_mums").alias("n_mums"), n.alias("n_lcb"), F.floor(F.sum("n_mums") / n).alias("mean_mums"), F.floor(F.sum(F.col("last_end")[0] - F.col("first_start")[0]) / n).alias("mean_length"))


@query(f"""
WITH {MATCHES}, p AS (SELECT *, lag(start) OVER w AS ps, lag(e) OVER w AS pe, lead(start) OVER w AS ns, lead(e) OVER w AS ne FROM m WINDOW w AS (PARTITION BY grp ORDER BY start[1], l_orderkey, l_linenumber, l_partkey, length)),
t AS (SELECT *, list_bool_and([x BETWEEN 0 AND 5000 FOR x IN [ns[1] - e[1], ns[2] - e[2], start[3] - ne[3]]]) AS after, list_bool_and([x BETWEEN 0 AND 5000 FOR x IN [start[1] - pe[1], start[2] - pe[2], ps[3] - e[3]]]) AS before FROM p)
SELECT grp, l_orderkey, l_linenumber, length FROM t WHERE length <= 30 AND ns IS NOT NULL AND NOT (after AND (ps IS NULL OR before))
""")
def random_mums(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = line_matches(spark, sf_dir).withColumn("ref_start", F.col("start")[0])
    return M.random_matches(m, "grp", ORDER, GENOMES, 30).select("grp", "l_orderkey", "l_linenumber", "length")
