"""Scores of the alignments of conversations; rows weigh by position, the halves are the odd and the even turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import columns as C
from genomill.operators import objectives as O
from genomill.plans.alignments import _SCORES, COLS, aln
from genomill.plans.registry import query

WEIGHTS = (
    ", e AS (SELECT set_id, col, ch, count(*) AS n FROM c WHERE ch <> '-' GROUP BY ALL), t AS (SELECT set_id, col, count(*) AS types FROM e GROUP BY ALL), "
    "raw AS (SELECT c.set_id, c.seq_id, sum(1.0::DOUBLE / (t.types * e.n)) AS raw FROM c JOIN e ON e.set_id = c.set_id AND e.col = c.col AND e.ch = c.ch JOIN t ON t.set_id = c.set_id AND t.col = c.col GROUP BY ALL), "
    "wt AS (SELECT set_id, seq_id, raw / sum(raw) OVER (PARTITION BY set_id) AS w FROM raw)"
)
# the pairs one by one: columns without both gaps, stretches between columns of letters, openings, halves at the ends
PAIRS = (
    f"WITH {COLS}{WEIGHTS}, px AS (SELECT x.set_id, x.seq_id AS a, y.seq_id AS b, x.col, (x.ch = '-')::INT AS gx, (y.ch = '-')::INT AS gy, CASE x.ch || y.ch {_SCORES} ELSE 0 END AS s FROM c x JOIN c y ON x.set_id = y.set_id AND x.col = y.col AND y.seq_id < x.seq_id), "
    "pz AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY col) AS i, count(*) OVER (PARTITION BY a, b) AS n, sum(1 - greatest(gx, gy)) OVER (PARTITION BY a, b ORDER BY col ROWS UNBOUNDED PRECEDING) AS stretch FROM px WHERE gx + gy < 2), "
    "po AS (SELECT set_id, a, b, sum(s) AS letters, count(DISTINCT stretch) FILTER (gx = 1) + count(DISTINCT stretch) FILTER (gy = 1) AS opened, max(CASE WHEN i = 1 THEN gx + gy ELSE 0 END) + max(CASE WHEN i = n THEN gx + gy ELSE 0 END) AS halves FROM pz GROUP BY set_id, a, b), "
    "ps AS (SELECT p.set_id, a, b, CAST(letters AS DOUBLE) AS letters, -400.0 * (opened - halves / 2.0) AS gaps, x.w * y.w AS w FROM po p JOIN wt x ON x.seq_id = a JOIN wt y ON y.seq_id = b)"
)
# profiles of each half, or of all rows (half 0 only)
PROFILES = (
    "WITH {cols}{weights}, h AS (SELECT c.*, w, {half} AS half, (ch = '-')::INT AS g FROM c JOIN wt ON wt.seq_id = c.seq_id), "
    "tr AS (SELECT *, lag(g) OVER v AS p, lead(g) OVER v AS n FROM h WINDOW v AS (PARTITION BY seq_id ORDER BY col)), "
    "pf AS (SELECT set_id, half, col, min(g) = 1 AS none, sum(CASE WHEN ch = 'A' THEN w WHEN ch = 'N' THEN w / 20 ELSE 0 END) / sum(w) AS fa, sum(CASE WHEN ch = 'C' THEN w WHEN ch = 'N' THEN w / 20 ELSE 0 END) / sum(w) AS fc, "
    "sum(CASE WHEN ch = 'G' THEN w WHEN ch = 'N' THEN w / 20 ELSE 0 END) / sum(w) AS fg, sum(CASE WHEN ch = 'T' THEN w WHEN ch = 'N' THEN w / 20 ELSE 0 END) / sum(w) AS ft, sum(w * (1 - g)) / sum(w) AS occ, "
    "(1 - sum(CASE WHEN coalesce(p, 0) = 0 AND g = 1 THEN w ELSE 0 END) / sum(w)) * -200 AS op, (1 - sum(CASE WHEN coalesce(n, 0) = 0 AND g = 1 THEN w ELSE 0 END) / sum(w)) * -200 AS cl FROM tr GROUP BY set_id, half, col), "
    "sc AS (SELECT *, fa * 151 + fc * -54 + fg * 29 + ft * -63 AS sa, fa * -54 + fc * 160 + fg * -65 + ft * 29 AS scc, fa * 29 + fc * -65 + fg * 160 + ft * -54 AS sg, fa * -63 + fc * 29 + fg * -54 + ft * 151 AS st FROM pf)"
)
HALVES = PROFILES.format(cols=COLS, weights=WEIGHTS, half="c.seq_id % 2") + (
    ", nb AS (SELECT *, NOT coalesce(lag(none) OVER v, false) AS starts, NOT coalesce(lead(none) OVER v, false) AS ends FROM sc WINDOW v AS (PARTITION BY set_id, half ORDER BY col)), "
    "bp AS (SELECT x.set_id, x.col, x.none AS xn, y.none AS yn, x.occ AS xo, y.occ AS yo, CASE WHEN x.none OR y.none THEN 0 ELSE x.fa * y.sa + x.fc * y.scc + x.fg * y.sg + x.ft * y.st END AS match, "
    "CASE WHEN x.none AND y.none THEN 0 WHEN x.none THEN CASE WHEN x.ends THEN y.cl ELSE 0 END + CASE WHEN x.starts THEN y.op ELSE 0 END WHEN y.none THEN CASE WHEN y.ends THEN x.cl ELSE 0 END + CASE WHEN y.starts THEN x.op ELSE 0 END ELSE 0 END AS gap "
    "FROM nb x JOIN nb y ON x.set_id = y.set_id AND x.col = y.col AND x.half = 0 AND y.half = 1)"
)


#: Added before rounding, so that sums that end in 5 round alike however they were added up.
TIE = 0.0000013


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.henikoff_weights(aln(spark, sf_dir))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + TIE, 4) + 0.0 for c in names})


@query(f"{PAIRS} SELECT set_id, a, b, letters, gaps FROM ps")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and gaps of every two rows of an alignment."""
    return O.pair_scores(aln(spark, sf_dir))


@query(f"{PAIRS} SELECT set_id, round(sum(w * letters) + 0.0000013, 4) + 0.0 AS letters, round(sum(w * gaps) + 0.0000013, 4) + 0.0 AS gaps, round(sum(w * (letters + gaps)) + 0.0000013, 4) + 0.0 AS score FROM ps GROUP BY set_id")
def objective_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of all pairs, letters and gaps."""
    return rounded(O.summed_pairs(O.pair_scores(aln(spark, sf_dir)), weights(spark, sf_dir)), "letters", "gaps", "score")


@query(f"{PAIRS} SELECT set_id, round(sum(w * (letters + gaps)) + 0.0000013, 4) + 0.0 AS score FROM ps WHERE a % 2 <> b % 2 GROUP BY set_id")
def objective_xp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted sum of the pairs between the two halves of an alignment."""
    across = F.col("a") % 2 != F.col("b") % 2
    return rounded(O.summed_pairs(O.pair_scores(aln(spark, sf_dir), between=across), weights(spark, sf_dir)), "score").select("set_id", "score")


_BESIDE = "CASE WHEN x.k = 'lg' AND y.k IN ('ll', 'gl') OR y.k = 'lg' AND x.k IN ('ll', 'gl') THEN -400.0 WHEN x.k = 'lg' AND y.k = 'gg' OR y.k = 'lg' AND x.k = 'gg' THEN -80.0 ELSE 0 END"


@query(f"""
WITH {COLS}{WEIGHTS}, g AS (SELECT c.*, w, CASE WHEN coalesce(lag(ch) OVER (PARTITION BY c.seq_id ORDER BY col), 'A') = '-' THEN 'g' ELSE 'l' END || CASE WHEN ch = '-' THEN 'g' ELSE 'l' END AS k FROM c JOIN wt ON wt.seq_id = c.seq_id)
SELECT x.set_id, round(sum(x.w * y.w * CASE x.ch || y.ch {_SCORES} ELSE 0 END) + 0.0000013, 4) + 0.0 AS letters, round(sum(x.w * y.w * {_BESIDE}) + 0.0000013, 4) + 0.0 AS gaps
FROM g x JOIN g y ON x.set_id = y.set_id AND x.col = y.col AND y.seq_id < x.seq_id GROUP BY x.set_id
""")
def objective_sp_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over pairs from the letters and gap transitions of columns; the SQL takes the pairs."""
    w = weights(spark, sf_dir)
    many = w.groupBy("set_id").count().where("count > 1").select("set_id")
    return rounded(O.fast_sum_of_pairs(O.weighted(aln(spark, sf_dir), w)), "letters", "gaps").join(many, "set_id", "left_semi").select("set_id", "letters", "gaps")


@query(PROFILES.format(cols=COLS, weights=WEIGHTS, half="0") + """
SELECT tr.set_id, round(sum(w * CASE WHEN g = 1 THEN CASE WHEN coalesce(p, 0) = 0 THEN op ELSE 0 END + CASE WHEN coalesce(n, 0) = 0 THEN cl ELSE 0 END
  WHEN ch = 'A' THEN sa WHEN ch = 'C' THEN scc WHEN ch = 'G' THEN sg WHEN ch = 'T' THEN st ELSE 0 END) + 0.0000013, 4) + 0.0 AS score FROM tr JOIN sc ON sc.set_id = tr.set_id AND sc.col = tr.col GROUP BY tr.set_id
""")
def objective_ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against the profile of its alignment."""
    return rounded(O.profile_sequence_score(O.weighted(aln(spark, sf_dir), weights(spark, sf_dir))), "score")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.between_profiles(O.weighted(aln(spark, sf_dir), weights(spark, sf_dir)))


@query(f"{HALVES} SELECT set_id, round(sum(match) + 0.0000013, 4) + 0.0 AS match, round(sum(gap) + 0.0000013, 4) + 0.0 AS gap, round(sum(match + gap) + 0.0000013, 4) + 0.0 AS score FROM bp GROUP BY set_id")
def objective_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the alignment of both halves' profiles scores as it stands."""
    total = halves(spark, sf_dir).groupBy("set_id").agg(F.sum("match").alias("match"), F.sum("gap").alias("gap")).withColumn("score", F.col("match") + F.col("gap"))
    return rounded(total, "match", "gap", "score")


@query(f"""
{HALVES} SELECT set_id, col, round(match + 0.0000013, 4) + 0.0 AS sp, round(match + 0.0000013, 4) + 0.0 AS ns, round(match + 300 + 0.0000013, 4) + 0.0 AS spn,
  round(CASE WHEN match = 0 THEN -2.5 WHEN match > 0 THEN (ln(match) + 0.52) * xo * yo END + 0.0000013, 4) + 0.0 AS le FROM bp WHERE NOT xn AND NOT yn
""")
def profile_column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four joint scores of two profiles' columns."""
    return rounded(O.column_scores(halves(spark, sf_dir)), "sp", "ns", "spn", "le")
