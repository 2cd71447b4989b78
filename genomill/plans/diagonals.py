"""Diagonals of every document with the reference of its language, those that agree, and the regions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators import diagonals as D
from genomill.operators.matches import compatible
from genomill.plans.matches import BASES_SQL, pairs
from genomill.plans.registry import query

# from the rule: last places, all hits, their extensions by halving steps, then one hit after the other
FOUND = f"""
s AS ({BASES_SQL}), t AS (SELECT lang, min(seq_id) AS ref_id FROM s GROUP BY lang),
g AS (SELECT ref_id, q.seq_id AS query_id, r.seq AS x, q.seq AS y FROM s q JOIN t USING (lang) JOIN s r ON r.seq_id = t.ref_id WHERE q.seq_id <> t.ref_id),
o AS (SELECT ref_id, query_id, length(x) >= length(y) AS swap, CASE WHEN length(x) >= length(y) THEN y ELSE x END AS p, CASE WHEN length(x) >= length(y) THEN x ELSE y END AS q FROM g WHERE least(length(x), length(y)) >= {D.K + D.SLOP}),
lasts AS (SELECT query_id, w, max(i) AS j FROM (SELECT query_id, i, substr(q, i, {D.K}) AS w FROM (SELECT query_id, q, unnest(range(1, length(q) - {D.K} + 1)) AS i FROM o)) GROUP BY ALL),
hits AS (SELECT h.query_id, h.i, l.j FROM (SELECT query_id, i, substr(p, i, {D.K}) AS w FROM (SELECT query_id, p, unnest(range(1, length(p) - {D.K} + 1)) AS i FROM o)) h JOIN lasts l ON l.query_id = h.query_id AND l.w = h.w),
near AS (SELECT h.query_id, i, j, p, q, length(substr(p, i + {D.K}, 16)) = 16 AND substr(p, i + {D.K}, 16) = substr(q, j + {D.K}, 16) AS far FROM hits h JOIN o USING (query_id)),
ext AS (SELECT query_id, i, j, {D.K} + list_reduce(CASE WHEN far THEN [1048576, 524288, 262144, 131072, 65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1] ELSE [8, 4, 2, 1] END,
          lambda n, z: n + CASE WHEN length(substr(p, i + {D.K} + n, z)) = z AND substr(p, i + {D.K} + n, z) = substr(q, j + {D.K} + n, z) THEN z ELSE 0 END, 0) AS n FROM near),
lst AS (SELECT query_id, list([{{'i': i, 'j': j, 'n': n, 'to': i + n}}] ORDER BY i) AS hs FROM ext GROUP BY query_id),
greedy AS (SELECT query_id, list_reduce(hs, lambda held, x: CASE WHEN x[1].i >= held[len(held)].to THEN list_append(held, x[1]) ELSE held END, [{{'i': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT), 'n': 0, 'to': CAST(0 AS BIGINT)}}]) AS hs FROM lst),
dg AS (SELECT ref_id, query_id, CAST(CASE WHEN swap THEN h.j ELSE h.i END - 1 AS BIGINT) AS a, CAST(CASE WHEN swap THEN h.i ELSE h.j END - 1 AS BIGINT) AS b, CAST(h.n AS BIGINT) AS len FROM (SELECT query_id, unnest(hs) AS h FROM greedy) JOIN o USING (query_id) WHERE h.n >= {D.SHORTEST}),
d AS (SELECT query_id AS grp, ref_id, row_number() OVER (PARTITION BY query_id ORDER BY a, b) - 1 AS i, a, b, len FROM dg)"""
AGREED = FOUND + """,
bad AS (SELECT x.grp, x.i AS i1, y.i AS i2, x.len AS len1, y.len AS len2 FROM d x JOIN d y ON x.grp = y.grp AND x.i < y.i
        WHERE NOT (x.a - x.b = y.a - y.b AND least(x.a + x.len, y.a + y.len) > greatest(x.a, y.a)) AND NOT (least(x.a + x.len, y.a + y.len) <= greatest(x.a, y.a) AND least(x.b + x.len, y.b + y.len) <= greatest(x.b, y.b))),
gone AS (SELECT grp, i2 AS i FROM bad WHERE NOT len2 > 4 * len1 UNION SELECT grp, i1 FROM bad WHERE NOT len1 > 4 * len2),
kept AS (SELECT * FROM d ANTI JOIN gone USING (grp, i)),
far AS (SELECT *, coalesce(max(b) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM kept),
ok AS (SELECT grp, ref_id, i, a, b, len FROM far x WHERE b > before AND NOT EXISTS (SELECT 1 FROM kept y WHERE y.grp = x.grp AND y.i > x.i AND y.b > x.before AND y.b <= x.b))"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diagonals(pairs(spark, sf_dir)).withColumnRenamed("query_id", "grp")


@query(f"WITH {FOUND} SELECT ref_id, grp AS query_id, i, a, b, len FROM d")
def diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common stretches of at least 24 symbols, found greedily from windows of 7 and their last places."""
    return found(spark, sf_dir).withColumnRenamed("grp", "query_id")


@query(f"WITH {AGREED} SELECT ref_id, grp AS query_id, a, b, len FROM ok")
def agreeing_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagonals that one alignment of the pair can run through."""
    d = found(spark, sf_dir)
    return compatible(d, "grp").select("ref_id", F.col("grp").alias("query_id"), "a", "b", "len")


@query(f"""
WITH {AGREED}, sp AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY a, b) AS n, a + {D.MARGIN} AS a0, b + {D.MARGIN} AS b0, a + len - {D.MARGIN} AS a1, b + len - {D.MARGIN} AS b1 FROM ok),
cut AS (SELECT grp, n, a0, b0, a1, b1 FROM sp UNION ALL SELECT query_id, coalesce(m, 0) + 1, length(x), length(y), NULL, NULL FROM g LEFT JOIN (SELECT grp, max(n) AS m FROM sp GROUP BY grp) k ON k.grp = g.query_id),
pr AS (SELECT *, coalesce(lag(a1) OVER w, 0) AS pa, coalesce(lag(b1) OVER w, 0) AS pb FROM cut WINDOW w AS (PARTITION BY grp ORDER BY n))
SELECT grp AS query_id, 2 * n - 2 AS nth, 'rect' AS kind, pa AS a, a0 - pa AS a_len, pb AS b, b0 - pb AS b_len FROM pr
UNION ALL SELECT grp, 2 * n - 1, 'diag', a0, a1 - a0, b0, b1 - b0 FROM pr WHERE a1 > a0
""")
def alignment_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles to align and diagonals to take as they are, in order; together they cover both sequences."""
    p = pairs(spark, sf_dir)
    sizes = p.select(F.col("query_id").alias("grp"), F.length("ref_seq").cast("long").alias("a_size"), F.length("seq").cast("long").alias("b_size"))
    return D.regions(compatible(D.diagonals(p).withColumnRenamed("query_id", "grp"), "grp"), sizes, "grp").withColumnRenamed("grp", "query_id")
