"""Column queries over the alignments of conversations, whose rows have gaps anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import PAMS, kimura
from genomill.operators import columns as C
from genomill.operators.merge import merged_columns
from genomill.plans.registry import load, query
from genomill.sources.scratch import spread
from genomill.sources.sequences import ALN_SQL, aligned_turns

ALN = ALN_SQL
COLS = ALN + ", c AS (SELECT set_id, seq_id, CAST(col AS INTEGER) AS col, substr(seq, col + 1, 1) AS ch FROM (SELECT *, unnest(range(0, length(seq))) AS col FROM aln))"
PROFILE = COLS + (
    ", n AS (SELECT set_id, col, count(*) AS n_seqs, count(*) FILTER (ch = 'A') AS n_a, count(*) FILTER (ch = 'C') AS n_c, count(*) FILTER (ch = 'G') AS n_g, count(*) FILTER (ch = 'T') AS n_t, count(*) FILTER (ch = 'N') AS n_n, count(*) FILTER (ch = '-') AS n_gap FROM c GROUP BY ALL), "
    "p AS (SELECT *, greatest(n_a, n_c, n_g, n_t, n_n) AS top, (n_a > 0)::INT + (n_c > 0)::INT + (n_g > 0)::INT + (n_t > 0)::INT + (n_n > 0)::INT AS n_types FROM n)"
)


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_turns(spark, sf_dir)


def cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.columns(aln(spark, sf_dir))


@query(f"WITH {COLS} SELECT set_id, seq_id, col, ch FROM c")
def aln_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cols(spark, sf_dir)


@query(f"WITH {PROFILE} SELECT set_id, col, CASE WHEN n_seqs = n_gap THEN 'N' WHEN n_a = top THEN 'A' WHEN n_c = top THEN 'C' WHEN n_g = top THEN 'G' WHEN n_n = top THEN 'N' ELSE 'T' END AS consensus FROM p")
def aln_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.profile(aln(spark, sf_dir)).select("set_id", "col", "consensus")


@query(f"WITH {PROFILE} SELECT set_id, round(avg(CAST(top AS DOUBLE) / n_seqs) FILTER (n_gap < n_seqs), 6) AS mean_conservation, round(avg(CAST(n_seqs - n_gap AS DOUBLE) / n_seqs), 6) AS mean_occupancy, max(n_types) AS most_types FROM p GROUP BY set_id")
def aln_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.profile(aln(spark, sf_dir))
    return p.groupBy("set_id").agg(F.round(F.avg(F.when(F.col("n_gap") < F.col("n_seqs"), F.col("conservation"))), 6).alias("mean_conservation"), F.round(F.avg("occupancy"), 6).alias("mean_occupancy"), F.max("n_types").alias("most_types"))


@query(f"WITH {PROFILE} SELECT set_id, col, n_types, round(CAST(n_seqs - n_gap AS DOUBLE) / n_seqs, 6) AS occupancy, CASE WHEN n_gap = 0 AND n_types = 1 THEN '*' WHEN n_gap = 0 AND n_n = 0 AND ((n_a + n_g = n_seqs) OR (n_c + n_t = n_seqs)) THEN ':' ELSE ' ' END AS mark FROM p")
def aln_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue types, occupancy and a conservation mark: one letter, or one chemical class (purines, pyrimidines)."""
    p = C.profile(aln(spark, sf_dir))
    alike = (F.col("n_a") + F.col("n_g") == F.col("n_seqs")) | (F.col("n_c") + F.col("n_t") == F.col("n_seqs"))
    mark = F.when((F.col("n_gap") == 0) & (F.col("n_types") == 1), "*").when((F.col("n_gap") == 0) & (F.col("n_n") == 0) & alike, ":").otherwise(" ")
    return p.select("set_id", "col", "n_types", F.round("occupancy", 6).alias("occupancy"), mark.alias("mark"))


IDENTITY = COLS + ", pr AS (SELECT x.set_id, x.seq_id AS a, y.seq_id AS b, count(*) AS n_both, count(*) FILTER (x.ch = y.ch) AS same FROM c x JOIN c y ON x.set_id = y.set_id AND x.col = y.col AND y.seq_id < x.seq_id AND x.ch <> '-' AND y.ch <> '-' GROUP BY ALL)"


@query(f"WITH {IDENTITY} SELECT set_id, a, b, n_both AS both, same, round(CAST(same AS DOUBLE) / n_both, 6) AS identity FROM pr")
def aln_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_identity(aln(spark, sf_dir)).withColumn("identity", F.round("identity", 6))


@query(f"""
WITH {IDENTITY}, d AS (SELECT a, b, 1 - CAST(same AS DOUBLE) / n_both AS p FROM pr)
SELECT a, b, round(1 - p, 6) AS identity, round(CASE WHEN p < 0.75 THEN -ln(1 - p - p * p / 5) WHEN p > 0.93 THEN 10 ELSE {PAMS}[least(greatest(CAST(floor((p - 0.75) * 1000 + 0.5) AS INTEGER), 0), {len(PAMS) - 1}) + 1] / 100.0 END, 6) AS kimura FROM d
""")
def kimura_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula, the table beyond 75 % difference and the cap beyond 93 %."""
    i = C.pair_identity(aln(spark, sf_dir))
    return i.select("a", "b", F.round("identity", 6).alias("identity"), F.round(kimura(F.col("identity")), 6).alias("kimura"))


@query(f"WITH {PROFILE} SELECT set_id, col, n_a, n_c, n_g, n_t FROM p WHERE n_gap = 0 AND n_n = 0 AND n_types > 1")
def core_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snps(C.profile(aln(spark, sf_dir))).select("set_id", "col", "n_a", "n_c", "n_g", "n_t")


@query(f"""
WITH {PROFILE}, snp AS (SELECT set_id, col FROM p WHERE n_gap = 0 AND n_n = 0 AND n_types > 1)
SELECT c.set_id, c.seq_id, string_agg(c.ch, '' ORDER BY c.col) AS snps FROM c JOIN snp ON c.set_id = snp.set_id AND c.col = snp.col GROUP BY c.set_id, c.seq_id
""")
def snp_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One string of core SNPs for each sequence."""
    a = aln(spark, sf_dir)
    return C.letters_at(C.at_columns(a, C.is_snp)).select("set_id", "seq_id", F.col("letters").alias("snps"))


@query(f"""
WITH {PROFILE}, snp AS (SELECT set_id, col FROM p WHERE n_gap = 0 AND n_n = 0 AND n_types > 1),
r AS (SELECT set_id, min(seq_id) AS ref_id FROM s GROUP BY set_id),
v AS (SELECT c.set_id, c.col, max(c.ch) FILTER (c.seq_id = r.ref_id) AS ref FROM c JOIN snp ON c.set_id = snp.set_id AND c.col = snp.col JOIN r ON r.set_id = c.set_id GROUP BY c.set_id, c.col)
SELECT 'set' || c.set_id AS chrom, c.col + 1 AS pos, v.ref, string_agg(DISTINCT c.ch, ',' ORDER BY c.ch) FILTER (c.ch <> v.ref) AS alt,
       string_agg(CASE WHEN c.ch = v.ref THEN '0' ELSE '1' END, '' ORDER BY c.seq_id) AS carriers
FROM c JOIN v ON c.set_id = v.set_id AND c.col = v.col GROUP BY c.set_id, c.col, v.ref
""")
def vcf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aln(spark, sf_dir)
    held = spread(C.letters_at(C.at_columns(a, C.is_snp)), "set_id", of=load(spark, sf_dir, "conversations"))  # letters, not rows; all columns of a set stay together
    c = held.select("set_id", "seq_id", F.inline(F.arrays_zip(F.col("at").alias("col"), F.split("letters", "(?!^)").alias("ch")))).where("ch <> ''")
    own = F.array_sort(F.collect_list(F.struct("seq_id", "ch")))
    v = c.groupBy("set_id", "col").agg(own.alias("own")).withColumn("ref", F.col("own")[0]["ch"])
    alt = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("own", lambda x: x["ch"]), lambda x: x != F.col("ref")))), ",")
    carriers = F.array_join(F.transform("own", lambda x: F.when(x["ch"] == F.col("ref"), "0").otherwise("1")), "")
    return v.select(F.concat(F.lit("set"), F.col("set_id").cast("string")).alias("chrom"), (F.col("col") + 1).alias("pos"), "ref", alt.alias("alt"), carriers.alias("carriers"))


@query(f"""
WITH {COLS}, g AS (SELECT *, (ch = '-')::INT AS g FROM c),
t AS (SELECT *, coalesce(lag(g) OVER w, 0) AS b, coalesce(lead(g) OVER w, 0) AS a FROM g WINDOW w AS (PARTITION BY set_id, seq_id ORDER BY col)),
f AS (SELECT set_id, col, avg(CASE WHEN ch = 'A' THEN 1.0 WHEN ch = 'N' THEN 0.05 ELSE 0 END::DOUBLE) AS f_a, avg(CASE WHEN ch = 'C' THEN 1.0 WHEN ch = 'N' THEN 0.05 ELSE 0 END::DOUBLE) AS f_c,
  avg(CASE WHEN ch = 'G' THEN 1.0 WHEN ch = 'N' THEN 0.05 ELSE 0 END::DOUBLE) AS f_g, avg(CASE WHEN ch = 'T' THEN 1.0 WHEN ch = 'N' THEN 0.05 ELSE 0 END::DOUBLE) AS f_t,
  avg((b = 0 AND g = 0)::INT) AS ll, avg((b = 0 AND g = 1)::INT) AS lg, avg((b = 1 AND g = 0)::INT) AS gl, avg((b = 1 AND g = 1)::INT) AS gg, avg((a = 0 AND g = 1)::INT) AS le FROM t GROUP BY set_id, col)
SELECT set_id, col, round(f_a, 6) AS f_a, round(f_c, 6) AS f_c, round(f_g, 6) AS f_g, round(f_t, 6) AS f_t, round(ll, 6) AS ll, round(lg, 6) AS lg, round(gl, 6) AS gl, round(gg, 6) AS gg,
  round((1 - lg) * -200, 6) AS gap_open, round((1 - le) * -200, 6) AS gap_close,
  round(f_a * 151 + f_c * -54 + f_g * 29 + f_t * -63, 6) + 0.0 AS score_a, round(f_a * -54 + f_c * 160 + f_g * -65 + f_t * 29, 6) + 0.0 AS score_c,
  round(f_a * 29 + f_c * -65 + f_g * 160 + f_t * -54, 6) + 0.0 AS score_g, round(f_a * -63 + f_c * 29 + f_g * -54 + f_t * 151, 6) + 0.0 AS score_t FROM f
""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.weighted_profile(aln(spark, sf_dir))
    return p.select("set_id", "col", *(F.round(c, 6).alias(c) for c in ("f_a", "f_c", "f_g", "f_t", "ll", "lg", "gl", "gg")), *((F.round(c, 6) + 0.0).alias(c) for c in ("gap_open", "gap_close", "score_a", "score_c", "score_g", "score_t")))


SMOOTH = PROFILE + (
    ", sm AS (SELECT set_id, col, n_gap, CAST(top AS DOUBLE) / n_seqs AS score, CASE WHEN count(*) OVER w = 7 THEN avg(least(CAST(top AS DOUBLE) / n_seqs, 0.9)) OVER w ELSE 0 END AS smooth "
    "FROM p WINDOW w AS (PARTITION BY set_id ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))"
)


@query(f"WITH {SMOOTH} SELECT set_id, col, round(score, 6) AS score, round(smooth, 6) AS smooth FROM sm")
def window_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.smoothed(aln(spark, sf_dir), ceiling=0.9).withColumn("score", F.col("conservation"))
    return s.select("set_id", "col", F.round("score", 6).alias("score"), F.round("smooth", 6).alias("smooth"))


@query(f"""
WITH {SMOOTH}, a AS (SELECT set_id, col FROM sm WHERE score >= 0.4 AND smooth >= 0.42 AND n_gap = 0)
SELECT set_id, col AS from_col, lead(col) OVER (PARTITION BY set_id ORDER BY col) AS to_col FROM a
""")
def anchor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns good enough to anchor an alignment, and the ranges between them."""
    return C.anchors(aln(spark, sf_dir), ceiling=0.9)


@query(f"""
WITH {COLS}, e AS (SELECT set_id, col, ch, count(*) AS n FROM c WHERE ch <> '-' GROUP BY ALL), t AS (SELECT set_id, col, count(*) AS types FROM e GROUP BY ALL),
r AS (SELECT c.set_id, c.seq_id, sum(1.0::DOUBLE / (t.types * e.n)) AS raw FROM c JOIN e ON e.set_id = c.set_id AND e.col = c.col AND e.ch = c.ch JOIN t ON t.set_id = c.set_id AND t.col = c.col GROUP BY ALL)
SELECT set_id, seq_id, round(raw / sum(raw) OVER (PARTITION BY set_id), 6) AS weight FROM r
""")
def henikoff_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.henikoff_weights(aln(spark, sf_dir)).select("set_id", "seq_id", F.round("weight", 6).alias("weight"))


_SCORES = " ".join(f"WHEN '{k}' THEN {v} WHEN '{k[::-1]}' THEN {v}" for k, v in C.NUC_SCORES.items())


@query(f"""
WITH {COLS} SELECT x.set_id, CAST(sum(CASE x.ch || y.ch {_SCORES} ELSE 0 END) AS BIGINT) AS letters
FROM c x JOIN c y ON x.set_id = y.set_id AND x.col = y.col AND y.seq_id < x.seq_id GROUP BY x.set_id
""")
def sum_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sum_of_pairs(aln(spark, sf_dir))


@query(f"""
WITH {PROFILE}, q AS (SELECT *, (CAST(n_gap AS DOUBLE) / n_seqs > 0.5)::INT AS y FROM p), i AS (SELECT *, sum(1 - y) OVER (PARTITION BY set_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS g FROM q),
r AS (SELECT *, sum(y) OVER (PARTITION BY set_id, g ORDER BY col ROWS UNBOUNDED PRECEDING) AS nth FROM i),
e AS (SELECT set_id, min(col) FILTER (y = 1 AND nth = 10) AS at_col FROM r GROUP BY set_id)
SELECT set_id, CASE WHEN at_col IS NOT NULL THEN CASE WHEN greatest(at_col - 10, 0) < 10 THEN 0 ELSE greatest(at_col - 10, 0) END END AS cut FROM e
""")
def indel_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.indel_stop(aln(spark, sf_dir))


@query(f"""
WITH {COLS}, r AS (SELECT set_id, min(seq_id) AS ref_id, 10 + set_id % 40 AS lo, 70 + set_id % 200 AS hi FROM s GROUP BY set_id),
n AS (SELECT r.*, col, sum((ch <> '-')::INT) OVER (PARTITION BY r.set_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS bases FROM r JOIN c ON c.set_id = r.set_id AND c.seq_id = r.ref_id),
x AS (SELECT set_id, min(col) FILTER (bases >= lo + 1) AS first, coalesce(min(col) FILTER (bases >= hi), max(col)) AS last FROM n GROUP BY set_id)
SELECT aln.set_id, seq_id, substr(seq, first + 1, last - first + 1) AS seq, first FROM aln JOIN x ON x.set_id = aln.set_id WHERE first IS NOT NULL
""")
def trim_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments cut to an interval of the bases of their reference, another one in each set; some end before it does."""
    a = aln(spark, sf_dir)
    ref = a.groupBy("set_id").agg(F.min("seq_id").alias("ref_id")).withColumns({"start": 10 + F.col("set_id") % 40, "end": 70 + F.col("set_id") % 200})
    return C.trimmed(a, ref)


@query(f"""
WITH {COLS}, r AS (SELECT set_id, min(seq_id) AS ref_id, min(seq_id) + 1 AS half FROM s GROUP BY set_id),
k AS (SELECT c.set_id, c.seq_id, c.col AS ref_pos, c.ch, CASE WHEN c.seq_id % 2 = r.ref_id % 2 THEN 0 ELSE 1 END AS chunk FROM c JOIN r ON r.set_id = c.set_id WHERE c.ch <> '-')
SELECT set_id, ref_pos, count(*) FILTER (chunk = 0) AS n_first, count(*) FILTER (chunk = 1) AS n_second, md5(string_agg(ch, '' ORDER BY seq_id)) AS column_md5 FROM k GROUP BY set_id, ref_pos
""")
def merge_reference_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alignments of each set, of its odd and even sequences, merged on the coordinates they share."""
    c = cols(spark, sf_dir)
    ref = c.groupBy("set_id").agg(F.min("seq_id").alias("ref_id"))
    k = c.join(ref, "set_id").where("ch <> '-'").select("set_id", "seq_id", F.col("col").alias("ref_pos"), "ch", (F.col("seq_id") % 2 != F.col("ref_id") % 2).cast("int").alias("chunk"))
    return merged_columns(k.where("chunk = 0"), k.where("chunk = 1"))


@query("""
WITH h AS (SELECT source AS file, n_chars % 50 AS header, doc_id % 4 AS chunk, doc_id AS idx FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY file, header ORDER BY chunk, idx) AS rn FROM h)
SELECT file, header, chunk, idx, row_number() OVER (PARTITION BY file ORDER BY chunk, idx) AS new_idx FROM f WHERE rn = 1
""")
def header_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each (file, header), numbered in order of arrival."""
    h = load(spark, sf_dir, "documents").select(F.col("source").alias("file"), (F.col("n_chars") % 50).alias("header"), (F.col("doc_id") % 4).alias("chunk"), F.col("doc_id").alias("idx"))
    first = h.groupBy("file", "header").agg(F.min(F.struct("chunk", "idx")).alias("f")).select("file", "header", "f.chunk", "f.idx")
    return first.withColumn("new_idx", F.row_number().over(Window.partitionBy("file").orderBy("chunk", "idx")))


@query(f"""
WITH {ALN}, o AS (SELECT set_id, seq_id, seq, list_sum([(i % 57 + 1) * ord(seq[i + 1]) FOR i IN range(0, length(seq))]) % 10000 AS checksum FROM aln) SELECT set_id, seq_id, CAST(checksum AS BIGINT) AS checksum FROM o
""")
def gcg_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(F.transform(F.split("seq", "(?!^)"), lambda ch, i: ((i % 57 + 1) * F.ascii(ch)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return aln(spark, sf_dir).select("set_id", "seq_id", (total % 10000).alias("checksum"))


@query(f"""
WITH {ALN}, e AS (SELECT set_id, seq_id, list_transform(regexp_extract_all(seq, '-+|[^-]+'), lambda x: CASE WHEN x[1] = '-' THEN -length(x) ELSE length(x) END) AS runs FROM aln)
SELECT set_id, seq_id, CAST(coalesce(list_sum([x FOR x IN runs IF x > 0]), 0) AS BIGINT) AS copied, CAST(-coalesce(list_sum([x FOR x IN runs IF x < 0]), 0) AS BIGINT) AS gaps, array_to_string(runs, ',') AS estring FROM e
""")
def edit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length edit strings: +n copies n symbols, -n inserts n gaps; applying one to the bare sequence restores the row."""
    from genomill.operators.paths import apply_edit_string, edit_string

    e = aln(spark, sf_dir).withColumn("runs", edit_string(F.col("seq"))).withColumn("again", apply_edit_string(F.regexp_replace("seq", "-", ""), F.col("runs")))
    copied = F.aggregate(F.filter("runs", lambda x: x > 0), F.lit(0), lambda a, x: a + x)
    gaps = -F.aggregate(F.filter("runs", lambda x: x < 0), F.lit(0), lambda a, x: a + x)
    return e.where("again = seq").select("set_id", "seq_id", copied.alias("copied"), gaps.alias("gaps"), F.array_join(F.col("runs").cast("array<string>"), ",").alias("estring"))
