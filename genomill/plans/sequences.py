"""Composition, filters, alphabets, reference choice and k-mer distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import AMBIGUOUS, VALID, clean, count_of, formula, kmers, reverse_complement
from genomill.operators.distances import kmer_distances, shared_kmers
from genomill.operators.recruit import ani_group, fast_cut, length_ratio
from genomill.plans.registry import load, query
from genomill.sources.sequences import SEQS_SQL, bounded, references, seqs

FIRST_BY_LANG = "first AS (SELECT lang, min(seq_id) AS ref_id FROM seqs GROUP BY lang), refs AS (SELECT s.lang, s.seq_id AS ref_id, s.seq AS ref_seq, length(s.seq) AS ref_len FROM seqs s JOIN first f ON s.seq_id = f.ref_id)"


@query(f"""
WITH s AS ({SEQS_SQL}),
c AS (SELECT seq_id, length(seq) AS size, length(seq) - length(replace(seq, 'A', '')) + length(seq) - length(replace(seq, 'T', '')) AS n_at,
             length(seq) - length(replace(seq, 'G', '')) + length(seq) - length(replace(seq, 'C', '')) AS n_gc, length(seq) - length(replace(seq, 'N', '')) AS n_n FROM s)
SELECT seq_id, size, n_at, n_gc, n_n, CASE WHEN size > n_n THEN round(n_gc * 100.0 / (size - n_n), 6) END AS gc_percent FROM c
""")
def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = seqs(spark, sf_dir).select("seq_id", F.length("seq").alias("size"), *(sum((count_of(F.col("seq"), x) for x in pair[1:]), count_of(F.col("seq"), pair[0])).alias(f"n_{pair.lower()}") for pair in ("AT", "GC", "N")))
    return c.withColumn("gc_percent", F.when(F.col("size") > F.col("n_n"), F.round(F.col("n_gc") * 100.0 / (F.col("size") - F.col("n_n")), 6)))


@query(f"""
WITH seqs AS ({SEQS_SQL}), {FIRST_BY_LANG}
SELECT s.seq_id, round(CAST(ref_len AS DOUBLE) / length(seq), 6) AS ratio FROM seqs s JOIN refs r ON s.lang = r.lang
WHERE length(seq) > 20 AND NOT contains(seq, '-') AND CAST(ref_len AS DOUBLE) / length(seq) > 0.8 AND CAST(ref_len AS DOUBLE) / length(seq) < 1.2
""")
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqs(spark, sf_dir)
    return length_ratio(s, bounded(references(s).select("lang", "ref_len")), ["lang"]).select("seq_id", F.round("ratio", 6).alias("ratio"))


@query(rf"""
WITH t AS (SELECT doc_id AS seq_id, regexp_replace(coalesce(text, ''), '[ \n]', '', 'g') AS s FROM documents)
SELECT seq_id, regexp_matches(s, '^[{VALID}{VALID.lower()}]*$') AS is_valid, length(s) - length(regexp_replace(s, '[^{VALID}{VALID.lower()}]', '', 'g')) AS n_invalid,
       md5(regexp_replace(s, '[^{VALID}{VALID.lower()}]', 'N', 'g')) AS fixed_md5 FROM t
""")
def valid_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, bad = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \n]", ""), f"[^{VALID}{VALID.lower()}]"
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), s.alias("s"))
    return t.select("seq_id", F.col("s").rlike(f"^[{VALID}{VALID.lower()}]*$").alias("is_valid"), (F.length("s") - F.length(F.regexp_replace("s", bad, ""))).alias("n_invalid"), F.md5(F.regexp_replace("s", bad, "N").cast("binary")).alias("fixed_md5"))


@query(rf"""
WITH t AS (SELECT doc_id AS seq_id, translate(regexp_replace(upper(translate(coalesce(text, ''), 'äöüßáéíóúñçàèêôœÄÖÜÁÉÍÓÚÑÇÀÈÊÔ', '')), '[^ACGTUXYSWKHRMVDBN\-]', '', 'g'), 'U{AMBIGUOUS}', 'T{"N" * len(AMBIGUOUS)}') AS s FROM documents)
SELECT seq_id, length(s) AS size, md5(s) AS seq_md5 FROM t
""")
def alphabet_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.upper(F.translate(F.coalesce("text", F.lit("")), "äöüßáéíóúñçàèêôœÄÖÜÁÉÍÓÚÑÇÀÈÊÔ", ""))
    t = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), clean(text).alias("s"))
    return t.select("seq_id", F.length("s").alias("size"), F.md5(F.col("s").cast("binary")).alias("seq_md5"))


@query("""
WITH p AS (SELECT regexp_extract(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '([^/]*)$', 1) AS stem FROM pages)
SELECT stem, count(*) AS n FROM p GROUP BY stem HAVING count(*) > 1
""")
def duplicate_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_extract(F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", ""), "([^/]*)$", 1)
    return load(spark, sf_dir, "pages").groupBy(stem.alias("stem")).agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS contig_idx,
       CAST(coalesce(sum(length(coalesce(text, ''))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS contig_start, length(coalesce(text, '')) AS size
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def contig_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, size = Window.partitionBy("conv_id").orderBy("turn"), F.length(F.coalesce("text", F.lit("")))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", size.alias("size"))
    return c.select("conv_id", "turn", F.row_number().over(w).alias("contig_idx"), F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("contig_start"), "size")


@query("""
WITH g AS (SELECT conv_id, string_agg(coalesce(text, ''), repeat('N', 310) ORDER BY turn) AS seq, count(*) AS n_contigs, sum(length(coalesce(text, ''))) AS bases FROM conversations GROUP BY conv_id)
SELECT conv_id, n_contigs, CAST(bases AS BIGINT) AS bases, length(seq) AS size, md5(seq) AS seq_md5 FROM g
""")
def genome_concat_padding(spark: SparkSession, sf_dir: str, d: int = 300) -> DataFrame:
    contigs = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("s")))), lambda x: x["s"])
    g = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(contigs.alias("c"))
    g = g.select("conv_id", F.size("c").cast("long").alias("n_contigs"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("bases"), F.array_join("c", "N" * (d + 10)).alias("seq"))
    return g.select("conv_id", "n_contigs", "bases", F.length("seq").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"WITH s AS ({SEQS_SQL}) SELECT seq_id, length(seq) AS size, md5(reverse(translate(seq, 'ACGTU', 'TGCAA'))) AS rc_md5 FROM s")
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("seq_id", F.length("seq").alias("size"), F.md5(reverse_complement(F.col("seq")).cast("binary")).alias("rc_md5"))


KMER_SQL = "k AS (SELECT seq_id, set_id, kmer, count(*) AS n FROM (SELECT seq_id, set_id, substr(seq, unnest(range(1, length(seq) - {k} + 2)), {k}) AS kmer FROM s WHERE length(seq) >= {k}) GROUP BY ALL)"


@query(f"""
WITH s AS ({SEQS_SQL}), {KMER_SQL.format(k=6)},
shared AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(least(x.n, y.n)) AS c FROM k x JOIN k y ON x.set_id = y.set_id AND x.kmer = y.kmer AND y.seq_id < x.seq_id GROUP BY 1, 2),
own AS (SELECT seq_id, set_id, greatest(length(seq) - 5, 0) AS c FROM s)
SELECT x.seq_id AS a, y.seq_id AS b, round(CASE WHEN x.c = 0 OR y.c = 0 THEN 1.0 ELSE least(3.0 * (x.c - coalesce(h.c, 0)) / x.c, 3.0 * (y.c - coalesce(h.c, 0)) / y.c) END, 6) AS d
FROM own x JOIN own y ON x.set_id = y.set_id AND y.seq_id < x.seq_id LEFT JOIN shared h ON h.a = x.seq_id AND h.b = y.seq_id
""")
def kmer_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_distances(seqs(spark, sf_dir), 6).select("a", "b", F.round("d", 6).alias("d"))


@query(f"""
WITH s AS ({SEQS_SQL}), {KMER_SQL.format(k=4)},
shared AS (SELECT x.seq_id AS a, y.seq_id AS b, sum(least(x.n, y.n)) AS c FROM k x JOIN k y ON x.set_id = y.set_id AND x.kmer = y.kmer AND y.seq_id < x.seq_id GROUP BY 1, 2),
own AS (SELECT seq_id, set_id, greatest(length(seq) - 3, 0) AS c FROM s)
SELECT x.seq_id AS a, y.seq_id AS b, round(CASE WHEN least(x.c, y.c) = 0 THEN 1.0 ELSE 1 - CAST(coalesce(h.c, 0) AS DOUBLE) / least(x.c, y.c) END, 6) AS d
FROM own x JOIN own y ON x.set_id = y.set_id AND y.seq_id < x.seq_id LEFT JOIN shared h ON h.a = x.seq_id AND h.b = y.seq_id
""")
def kmer_fraction_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_distances(seqs(spark, sf_dir), 4, fraction=True).select("a", "b", F.round("d", 6).alias("d"))


@query(f"""
WITH s AS ({SEQS_SQL}), k AS (SELECT DISTINCT seq_id, set_id, substr(seq, unnest(range(1, length(seq) - 1)), 3) AS kmer FROM s WHERE length(seq) >= 3),
own AS (SELECT seq_id, set_id, count(*) AS c FROM k GROUP BY ALL),
shared AS (SELECT x.seq_id AS a, y.seq_id AS b, count(*) AS c FROM k x JOIN k y ON x.set_id = y.set_id AND x.kmer = y.kmer AND y.seq_id < x.seq_id GROUP BY 1, 2)
SELECT a, b, h.c AS common_bits, round(1 - CAST(h.c AS DOUBLE) / least(x.c, y.c), 6) AS d FROM shared h JOIN own x ON x.seq_id = h.a JOIN own y ON y.seq_id = h.b
""")
def kmer_bit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from sets of 3-mers: a row for each pair of a set that shares one."""
    k = seqs(spark, sf_dir).select("seq_id", "set_id", F.array_distinct(kmers(F.col("seq"), 3)).alias("bits"))
    x, y = k.select("set_id", F.col("seq_id").alias("a"), F.col("bits").alias("x")), k.select("set_id", F.col("seq_id").alias("b"), F.col("bits").alias("y"))
    pairs = x.join(y, "set_id").where("b < a").withColumn("common_bits", F.size(F.array_intersect("x", "y")).cast("long")).where("common_bits > 0")
    return pairs.select("a", "b", "common_bits", F.round(1 - F.col("common_bits") / F.least(F.size("x"), F.size("y")), 6).alias("d"))


@query(f"""
WITH seqs AS ({SEQS_SQL}), {FIRST_BY_LANG}, s AS (SELECT seq_id, seq_id AS set_id, seq FROM seqs), {KMER_SQL.format(k=6)},
rk AS (SELECT r.lang, k.kmer, k.n FROM refs r JOIN k ON k.seq_id = r.ref_id),
shared AS (SELECT k.seq_id, sum(least(k.n, rk.n)) AS c FROM k JOIN seqs q ON q.seq_id = k.seq_id JOIN rk ON rk.lang = q.lang AND rk.kmer = k.kmer GROUP BY k.seq_id),
d AS (SELECT q.seq_id, q.lang, CASE WHEN length(q.seq) < 6 OR ref_len < 6 THEN 1.0 ELSE 1 - CAST(coalesce(c, 0) AS DOUBLE) / (least(length(q.seq), ref_len) - 5) END AS d
      FROM seqs q JOIN refs r ON q.lang = r.lang LEFT JOIN shared h ON h.seq_id = q.seq_id WHERE q.seq_id <> r.ref_id),
near AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY d, seq_id) AS rn FROM d WHERE d < 0.5),
cut AS (SELECT lang, min(d) + 3 * stddev_pop(d) AS top FROM near WHERE rn <= 101 GROUP BY lang)
SELECT n.lang, n.seq_id, round(n.d, 6) AS d, round(c.top, 6) AS cut FROM near n JOIN cut c ON n.lang = c.lang WHERE n.d <= c.top
""")
def recruit_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqs(spark, sf_dir)
    pairs = s.select("lang", F.col("seq_id").alias("query_id"), "seq").join(bounded(references(s)), "lang").where("query_id <> ref_id")
    d = F.when((F.col("len") < 6) | (F.col("ref_len") < 6), 1.0).otherwise(1 - F.col("c") / (F.least("len", "ref_len") - 5))
    rows = shared_kmers(pairs.withColumn("len", F.length("seq")), 6, ("lang", "len", "ref_len")).select("lang", F.col("query_id").alias("seq_id"), d.alias("d"))
    return fast_cut(rows, "lang", limit=0.5).select("lang", "seq_id", F.round("d", 6).alias("d"), F.round("cut", 6).alias("cut"))


ANI_SQL = "ani AS (SELECT l_orderkey AS query, l_suppkey AS ref, 90 + l_discount * 100 AS ani, l_quantity AS matched, 50.0 AS total FROM lineitem)"


def ani_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("ref"), (90 + F.col("l_discount") * 100).alias("ani"), F.col("l_quantity").alias("matched"), F.lit(50.0).alias("total"))


@query(f"""
WITH {ANI_SQL}, kept AS (SELECT DISTINCT query, ref FROM ani WHERE ani >= 95 AND 100 * matched / total >= 20),
best AS (SELECT ref FROM kept GROUP BY ref ORDER BY count(*) DESC, ref LIMIT 1)
SELECT k.query, k.ref FROM kept k JOIN best b ON k.ref = b.ref
""")
def ani_reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ani_group(ani_rows(spark, sf_dir), 95.0, 20.0)


@query(f"""
WITH {ANI_SQL}, kept AS (SELECT DISTINCT query, ref FROM ani WHERE ani >= 95 AND 100 * matched / total >= 20),
best AS (SELECT ref FROM kept GROUP BY ref ORDER BY count(*) DESC, ref LIMIT 1), near AS (SELECT k.query FROM kept k JOIN best b ON k.ref = b.ref)
SELECT o_orderkey AS query, o_orderkey IN (SELECT query FROM near) AS by_ani FROM orders
""")
def curated_add_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated input keeps every genome: those that the filter dropped are added back."""
    near = ani_group(ani_rows(spark, sf_dir), 95.0, 20.0).select("query").distinct()
    everything = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"))
    return near.join(everything, "query", "left_semi").withColumn("by_ani", F.lit(True)).unionByName(everything.join(near, "query", "left_anti").withColumn("by_ani", F.lit(False)))


@query(f"WITH s AS ({SEQS_SQL}) SELECT seq_id, least(3000, greatest(500, length(seq) // 100)) AS fragment FROM s")
def fragment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("seq_id", F.least(F.lit(3000), F.greatest(F.lit(500), F.floor(F.length("seq") / 100))).alias("fragment"))


@query("""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT d.doc_id, d.source, n.n, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS i FROM documents d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, CAST(CASE WHEN n >= 20 THEN i // (n // (n // 10)) ELSE 0 END AS BIGINT) AS chunk FROM r
""")
def partition_assign(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """Partitions of each source: n // least of them, of n // (n // least) genomes; one if there are fewer than 2 * least."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    w = Window.partitionBy("source")
    r = d.select("doc_id", "source", F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy("doc_id")) - 1).alias("i"))
    size = F.floor(F.col("n") / F.greatest(F.floor(F.col("n") / least), F.lit(1)))
    return r.select("doc_id", "source", F.when(F.col("n") >= 2 * least, F.floor(F.col("i") / size)).otherwise(0).alias("chunk"))


@query(f"""
WITH s AS ({SEQS_SQL}), p AS (SELECT seq_id, length(seq) AS n, unnest(range(0, greatest(length(seq), 1), 1000)) AS a FROM s)
SELECT seq_id, a AS win_start, CASE WHEN n - (a + 1000) < 50 THEN n ELSE a + 1000 END AS win_end FROM p WHERE a = 0 OR n - a >= 50
""")
def search_windows(spark: SparkSession, sf_dir: str, size: int = 1000, tail: int = 50) -> DataFrame:
    """Windows of the reference that are searched one by one; a tail shorter than the overlap joins the last window."""
    n = F.length("seq")
    p = seqs(spark, sf_dir).select("seq_id", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long"), F.lit(1)) - 1, F.lit(size).cast("long"))).alias("win_start"))
    p = p.where((F.col("win_start") == 0) | (F.col("n") - F.col("win_start") >= tail))
    return p.select("seq_id", "win_start", F.when(F.col("n") - (F.col("win_start") + size) < tail, F.col("n")).otherwise(F.col("win_start") + size).alias("win_end"))


@query(f"WITH s AS ({SEQS_SQL}) SELECT seq_id, CAST(ceil(1.1 * log2(length(seq))) AS BIGINT) AS least FROM s WHERE length(seq) > 0")
def minimum_match_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).where(F.length("seq") > 0).select("seq_id", formula("1.1*(Log(S))", F.length("seq")).alias("least"))
