"""Core-genome files of each document and the reference of its language, and the records that are read back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import folded
from genomill.operators import matches as M
from genomill.operators import written as O
from genomill.plans.matches import PAIRS, bases, pairs
from genomill.plans.registry import load, query
from genomill.sources import formats as R
from genomill.sources.sequences import FOLD_SQL

LEAST, MOST, SEED = 13, 20, 13  # columns that a written block exceeds; symbols between matches of a run; least match


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, size, offsets, file, header: a document's lines that hold bases are its contigs."""
    lines = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    sized = lines.select("seq_id", "lang", "k", F.length(F.replace(folded(F.col("line")), F.lit("N"), F.lit(""))).alias("n"))
    own = sized.withColumn("at", F.sum("n").over(Window.partitionBy("seq_id").orderBy("k")) - F.col("n"))  # numbers only; a sequence's lines are one window
    starts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("at"))))
    g = own.groupBy("seq_id").agg(F.max("lang").alias("lang"), F.sum("n").alias("size"), starts.alias("offsets"))
    return g.select("seq_id", "size", "offsets", F.format_string("doc%d.fna", "seq_id").alias("file"), F.concat_ws(" ", "lang", F.col("seq_id").cast("string")).alias("header"))


BLOCKS = (
    PAIRS.format(k=SEED) + ", dg AS (SELECT *, query_start - ref_start AS dia FROM mm), lg AS (SELECT *, ref_start - lag(ref_start + length) OVER (PARTITION BY ref_id, query_id, fwd, dia ORDER BY ref_start) AS d FROM dg), "
    f"rn AS (SELECT *, CASE WHEN d <= {MOST} THEN d ELSE 0 END AS gap, sum(CASE WHEN d <= {MOST} THEN 0 ELSE 1 END) OVER (PARTITION BY ref_id, query_id, fwd, dia ORDER BY ref_start) AS run FROM lg), "
    "pc AS (SELECT rn.*, a.seq AS rs, CASE WHEN fwd THEN x.seq ELSE reverse(translate(x.seq, 'ACGTU', 'TGCAA')) END AS qs FROM rn JOIN s a ON a.seq_id = ref_id JOIN s x ON x.seq_id = query_id), "
    "bl AS (SELECT ref_id, query_id, fwd, min(ref_start) AS st, max(ref_start + length) AS en, min(query_start) AS q, arg_min(length, ref_start) AS first, "
    "string_agg(substr(rs, ref_start - gap + 1, gap) || lower(substr(rs, ref_start + 1, length)), '' ORDER BY ref_start) AS a, string_agg(substr(qs, query_start - gap + 1, gap) || lower(substr(qs, query_start + 1, length)), '' ORDER BY ref_start) AS b FROM pc GROUP BY ref_id, query_id, fwd, dia, run), "
    "nb AS (SELECT *, row_number() OVER (PARTITION BY ref_id, query_id ORDER BY st, fwd DESC, q) AS z, count(*) OVER (PARTITION BY ref_id, query_id) AS total FROM bl), "
    f"tr AS (SELECT *, greatest(coalesce(max(en) OVER (PARTITION BY ref_id, query_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - st, 0) AS cut FROM nb WHERE length(a) > {LEAST}), "
    f"ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents), lb AS (SELECT doc_id, k, length(replace({FOLD_SQL}, 'N', '')) AS n FROM ln), "
    "ct AS (SELECT doc_id, list(o ORDER BY k) AS offs FROM (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS o FROM lb WHERE n > 0) GROUP BY doc_id), "
    "w AS (SELECT tr.*, st + cut AS rst, length(x.seq) AS qn, substr(a, cut + 1) AS ra, substr(b, cut + 1) AS rb, c1.offs AS o1, c2.offs AS o2, CASE WHEN fwd THEN q + cut ELSE length(x.seq) - q - (en - st) END AS qst, CASE WHEN fwd THEN q + en - st ELSE length(x.seq) - q - cut END AS qen "
    f"FROM tr JOIN s x ON x.seq_id = query_id JOIN ct c1 ON c1.doc_id = ref_id JOIN ct c2 ON c2.doc_id = query_id WHERE length(a) - cut > {LEAST}), "
    "ps AS (SELECT *, len(list_filter(o1, lambda o: o <= rst)) AS n1, len(list_filter(o2, lambda o: o <= CASE WHEN fwd THEN qst ELSE qn - q - first END)) AS n2 FROM w), "
    "rec AS (SELECT *, CAST(rst - o1[n1] + CASE WHEN n1 = 1 THEN 1 ELSE 0 END AS BIGINT) AS p1, CAST(CASE WHEN fwd THEN qst ELSE qen END - o2[n2] + CASE WHEN n2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS p2 FROM ps)"
)
WRAP = "rtrim(regexp_replace({}, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) || chr(10)"
RECORDS = (
    "'> 1:' || (rst + 1) || '-' || en || ' + cluster' || z || ' s' || n1 || ':p' || p1 || chr(10) || " + WRAP.format("ra")
    + " || '> 2:' || (qst + 1) || '-' || qen || CASE WHEN fwd THEN ' + ' ELSE ' - ' END || 'cluster' || z || ' s' || n2 || ':p' || p2 || chr(10) || " + WRAP.format("rb") + " || '=' || chr(10)"
)
ENTRY = "'##SequenceIndex {i}' || chr(10) || '##SequenceFile doc' || {s}.seq_id || '.fna' || chr(10) || '##SequenceHeader >' || {s}.lang || ' ' || {s}.seq_id || chr(10) || '##SequenceLength ' || length({s}.seq) || 'bp' || chr(10)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    g = genomes(spark, sf_dir)
    return O.core_files(O.diagonal_blocks(M.pair_matches(p, SEED), p, MOST), p, g, LEAST)


@query(f"""
WITH {BLOCKS}, body AS (SELECT ref_id, query_id, count(*) AS written, string_agg({RECORDS}, '' ORDER BY z) AS body FROM rec GROUP BY ref_id, query_id), tot AS (SELECT ref_id, query_id, max(total) AS total FROM nb GROUP BY ref_id, query_id)
SELECT a.seq_id AS ref_id, x.seq_id AS query_id, coalesce(written, 0) AS written,
  '#FormatVersion Mauve' || chr(10) || '#SequenceCount 2' || chr(10) || {ENTRY.format(i=1, s="a")} || {ENTRY.format(i=2, s="x")} || '#IntervalCount ' || coalesce(total, 0) || chr(10) || coalesce(body, '') AS text
FROM r JOIN s a ON a.seq_id = ref_id JOIN s x ON x.lang = r.lang AND x.seq_id <> ref_id LEFT JOIN body ON body.ref_id = a.seq_id AND body.query_id = x.seq_id LEFT JOIN tot ON tot.ref_id = a.seq_id AND tot.query_id = x.seq_id
""")
def core_genome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole file of every document and its reference: head, blocks without shared reference symbols, places on contigs, lines of 80."""
    return files(spark, sf_dir)


@query(f"""
WITH {BLOCKS} SELECT ref_id, query_id, CAST(z AS INTEGER) AS cluster, 1 AS idx, rst + 1 AS start, en AS "end", 1 AS strand, CAST(n1 AS INTEGER) AS contig_idx, p1 AS contig_pos, ra AS seq FROM rec
UNION ALL SELECT ref_id, query_id, CAST(z AS INTEGER), 2, qst + 1, qen, CASE WHEN fwd THEN 1 ELSE -1 END, CAST(n2 AS INTEGER), p2, rb FROM rec
""")
def core_genome_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of these files, read back."""
    return R.xmfa_records(files(spark, sf_dir), "text", "ref_id", "query_id")
