"""Interval queries over the events: contig = event type, chunk = user modulo 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import intervals as I
from genomill.operators.recombination import recombination_records
from genomill.plans.registry import load, query

IV = "iv AS (SELECT event_id, event_type AS contig, user_id % 3 AS chunk, CAST(floor(value * 10) AS BIGINT) AS s, CAST(floor(value * 10) AS BIGINT) + event_id % 40 + 1 AS e FROM events)"
MERGED = (
    "far AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM iv), "
    "mark AS (SELECT *, sum(CASE WHEN f IS NULL OR s > f THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM far), m AS (SELECT {k}, min(s) AS s, max(e) AS e FROM mark GROUP BY {k}, g)"
)


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.col("value") * 10)
    return load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("contig"), (F.col("user_id") % 3).alias("chunk"), start.alias("start"), (start + F.col("event_id") % 40 + 1).alias("end"))


@query(f"WITH {IV}, l AS (SELECT *, lag(e) OVER (PARTITION BY chunk, contig ORDER BY s, e, event_id) AS p FROM iv) SELECT event_id, CASE WHEN p > s THEN p + 1 ELSE s END AS start, e AS \"end\" FROM l")
def cut_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cut_overlaps(event_intervals(spark, sf_dir), ["chunk", "contig"], ("start", "end", "event_id")).select("event_id", "start", "end")


@query(f"""
WITH {IV}, {MERGED.format(k="chunk, contig")}
SELECT a.contig, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM m a JOIN m b ON a.contig = b.contig AND a.chunk = 0 AND b.chunk = 1 AND greatest(a.s, b.s) < least(a.e, b.e)
""")
def interval_intersect2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.merged(event_intervals(spark, sf_dir), ["chunk", "contig"])
    return I.intersect(m.where("chunk = 0").drop("chunk"), m.where("chunk = 1").drop("chunk"), ["contig"])


@query(f"""
WITH {IV}, {MERGED.format(k="chunk, contig")},
two AS (SELECT a.contig, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM m a JOIN m b ON a.contig = b.contig AND a.chunk = 0 AND b.chunk = 1 AND greatest(a.s, b.s) < least(a.e, b.e)),
three AS (SELECT a.contig, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM two a JOIN m b ON a.contig = b.contig AND b.chunk = 2 AND greatest(a.s, b.s) < least(a.e, b.e))
SELECT contig, s AS start, e AS "end" FROM three WHERE e - s >= 10
""")
def interval_intersect_all(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    return I.intersect_all(event_intervals(spark, sf_dir), "chunk", ["contig"], 3).where(F.col("end") - F.col("start") >= least)


@query(f"""
WITH {IV}, {MERGED.format(k="chunk, contig")}
SELECT chunk, count(*) AS n_lcb, sum(e - s) AS covered, avg(e - s) AS mean_length FROM m GROUP BY chunk
""")
def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.merged(event_intervals(spark, sf_dir), ["chunk", "contig"])
    return m.groupBy("chunk").agg(F.count("*").alias("n_lcb"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.avg(F.col("end") - F.col("start")).alias("mean_length"))


@query(f"""
WITH {IV}, {MERGED.format(k='contig')}, z AS (SELECT contig, max(e) + 25 AS size FROM iv GROUP BY contig), x AS (SELECT contig, s, e FROM m UNION ALL SELECT contig, size, size FROM z),
n AS (SELECT contig, coalesce(lag(e) OVER (PARTITION BY contig ORDER BY s, e), 0) AS start, s AS "end" FROM x) SELECT * FROM n WHERE "end" - start >= 2
""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that no interval covers, of contigs that end 25 places after their last one."""
    x = event_intervals(spark, sf_dir)
    return I.complement(x, ["contig"], x.groupBy("contig").agg((F.max("end") + 25).alias("size")))


@query(f"WITH {IV}, {MERGED.format(k='chunk, contig')} SELECT chunk, contig, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS islands FROM m GROUP BY chunk, contig")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.union_length(event_intervals(spark, sf_dir), ["chunk", "contig"])


@query(f"WITH {IV}, {MERGED.format(k='chunk, contig')} SELECT chunk, contig, s AS start, e AS \"end\", lag(e) OVER w AS left_end, lead(s) OVER w AS right_start FROM m WINDOW w AS (PARTITION BY chunk, contig ORDER BY s)")
def covered_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.neighbours(event_intervals(spark, sf_dir), ["chunk", "contig"])


@query(f"""
WITH {IV}, h AS (SELECT contig, chunk AS block, s AS pos, round((event_id % 400) / 4000.0, 5) AS p, event_id FROM iv),
hit AS (SELECT *, row_number() OVER (PARTITION BY contig, greatest(pos - 50, 0) ORDER BY event_id DESC) AS rn FROM h WHERE p >= 0 AND p < 0.01)
SELECT contig AS chrom, greatest(pos - 50, 0) AS start, pos + 50 AS "end", 'REC' AS name, p AS score, '+' AS strand FROM hit WHERE rn = 1
""")
def recombination_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = event_intervals(spark, sf_dir).select("contig", F.col("start").alias("pos"), F.round((F.col("event_id") % 400) / 4000.0, 5).alias("p"), "event_id")
    return recombination_records(h)
