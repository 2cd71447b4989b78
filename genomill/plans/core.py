"""What lies between searching matches and writing the core genome: verified matches, gates, contigs, orders, windows and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genomill.functions.sequence import reverse_complement
from genomill.operators import columns as C
from genomill.operators import intervals as I
from genomill.operators import matches as M
from genomill.operators.merge import merged_rows
from genomill.plans.alignments import _SCORES, ALN, COLS, IDENTITY, aln, cols
from genomill.plans.intervals import IV, MERGED, event_intervals
from genomill.plans.matches import CHAIN, GENOMES, MATCHES, MUMI, PAIRS, line_clusters, line_matches, mumi_rows, pairs
from genomill.plans.registry import load, query
from genomill.plans.trees import TREE_SQL, ancestors, hierarchy
from genomill.sources.sequences import SHORT_SQL, short_seqs

# matches


@query(f"""
WITH {PAIRS.format(k=13)}, z AS (SELECT m.*, a.seq AS a, x.seq AS x, CASE WHEN m.fwd THEN query_start ELSE length(x.seq) - (query_start + m.length) END AS start FROM mm m JOIN s a ON a.seq_id = m.ref_id JOIN s x ON x.seq_id = m.query_id)
SELECT ref_id, query_id, fwd, ref_start, start, length FROM z
WHERE start >= 0 AND start + length <= length(x) AND length >= 5 AND (fwd OR reverse(translate(substr(x, start + 1, length), 'ACGTU', 'TGCAA')) = substr(a, ref_start + 1, length))
""")
def verified_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on the coordinates of the forward strand, inside both sequences; those on the reverse strand are compared with the reference again."""
    p = pairs(spark, sf_dir)
    m = M.pair_matches(p, 13).join(p, ["ref_id", "query_id"]).withColumn("start", F.when(F.col("fwd"), F.col("query_start")).otherwise(F.length("seq") - (F.col("query_start") + F.col("length"))))
    cut = lambda c, at: F.substring(c, at + 1, F.col("length").cast("int"))
    same = F.col("fwd") | (reverse_complement(cut(F.col("seq"), F.col("start").cast("int"))) == cut(F.col("ref_seq"), F.col("ref_start").cast("int")))
    return m.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.length("seq")) & (F.col("length") >= 5) & same).select("ref_id", "query_id", "fwd", "ref_start", "start", "length")


@query(f"""
WITH {PAIRS.format(k=13)}, best AS (SELECT *, row_number() OVER (PARTITION BY ref_id, query_id, ref_start ORDER BY length DESC, fwd) AS rn FROM mm)
SELECT ref_id, query_id, ref_start, fwd, length FROM best WHERE rn = 1
""")
def strand_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One match for each start on the reference: the one that reaches further; the forward strand only if it reaches strictly further."""
    best = F.max(F.struct("length", (~F.col("fwd")).alias("back"))).alias("m")
    return M.pair_matches(pairs(spark, sf_dir), 13).groupBy("ref_id", "query_id", "ref_start").agg(best).select("ref_id", "query_id", "ref_start", (~F.col("m.back")).alias("fwd"), "m.length")


@query(f"""
WITH {CHAIN}, g AS (SELECT grp, sum(abs(le[1] - fs[1])) AS covered FROM kept GROUP BY grp), z AS (SELECT l_suppkey AS grp, max(l_orderkey) * 80 AS size FROM lineitem GROUP BY grp)
SELECT grp, round(100.0 * covered / size, 6) AS percent, CASE WHEN 100.0 * covered / size <= 1 THEN 'stop' WHEN 100.0 * covered / size < 10 THEN 'warn' ELSE 'pass' END AS gate FROM g JOIN z USING (grp)
""")
def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the reference that clusters cover: 1 % or less stops a run, less than 10 % is a warning."""
    covered = line_clusters(spark, sf_dir).groupBy("grp").agg(F.sum(F.abs(F.col("last_end")[0] - F.col("first_start")[0])).alias("covered"))
    size = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg((F.max("l_orderkey") * 80).alias("size"))
    percent = F.lit(100.0) * F.col("covered") / F.col("size")
    return covered.join(size, "grp").select("grp", F.round(percent, 6).alias("percent"), F.when(percent <= 1, "stop").when(percent < 10, "warn").otherwise("pass").alias("gate"))


REGIONS = CHAIN + ", n AS (SELECT *, lead(fs) OVER w AS ns, lead(fe) OVER w AS ne, lead(lcb) OVER w AS n_lcb FROM kept WINDOW w AS (PARTITION BY grp ORDER BY lcb)), x AS (SELECT grp, lcb, n_lcb, [ns[1] - le[1], ns[2] - le[2], ls[3] - ne[3]] AS gaps FROM n WHERE n_lcb IS NOT NULL)"


@query(f"WITH {REGIONS} SELECT grp, lcb, list_min(gaps) AS shortest, list_max(gaps) AS longest FROM x WHERE list_min(gaps) >= 5")
def region_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest and longest part of each region between clusters."""
    return M.between_clusters(line_clusters(spark, sf_dir), "grp", GENOMES).select("grp", "lcb", F.array_min("gaps").alias("shortest"), F.array_max("gaps").alias("longest"))


@query(f"WITH {REGIONS} SELECT DISTINCT grp, gaps[1] AS g1, gaps[2] AS g2, gaps[3] AS g3 FROM x WHERE list_min(gaps) >= 5")
def region_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.between_clusters(line_clusters(spark, sf_dir), "grp", GENOMES).select("grp", *(F.col("gaps")[i].alias(f"g{i + 1}") for i in range(GENOMES))).distinct()


@query(f"WITH {REGIONS}, y AS (SELECT grp, lcb, 0 AS between, 0 AS ord FROM kept UNION ALL SELECT grp, lcb, 1, -1 FROM x WHERE list_min(gaps) >= 5) SELECT grp, lcb, between, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord, lcb) AS INTEGER) AS place FROM y")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a group in the order in which they are written: those made between others come first."""
    c = line_clusters(spark, sf_dir)
    both = M.between_clusters(c, "grp", GENOMES).select("grp", "lcb", F.lit(1).alias("between")).unionByName(c.select("grp", "lcb", F.lit(0).alias("between")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("between"), "lcb")))


@query(f"WITH {MATCHES} SELECT grp, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN start[1] - length ELSE start[1] END AS first, CASE WHEN l_linenumber % 2 = 0 THEN start[1] ELSE start[1] + length END AS last FROM m")
def record_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that a record covers: on the reverse strand (here: even lines) they end where it starts."""
    back, at = F.col("l_linenumber") % 2 == 0, F.col("start")[0]
    return line_matches(spark, sf_dir).select("grp", "l_orderkey", "l_linenumber", F.when(back, at - F.col("length")).otherwise(at).alias("first"), F.when(back, at).otherwise(at + F.col("length")).alias("last"))


@query(f"""
WITH {IV}, {MERGED.format(k='chunk, contig')}, o AS (SELECT *, row_number() OVER (PARTITION BY chunk, contig ORDER BY s) AS nth FROM m)
SELECT a.contig, a.nth, a.s AS s0, a.e AS e0, b.s AS s1, b.e AS e1 FROM o a JOIN o b ON a.contig = b.contig AND a.nth = b.nth AND a.chunk = 0 AND b.chunk = 1
""")
def zipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th block of one partition beside the n-th of the other."""
    m = I.merged(event_intervals(spark, sf_dir), ["chunk", "contig"])
    o = m.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "contig").orderBy("start")).cast("long"))
    side = lambda k: o.where(F.col("chunk") == k).select("contig", "nth", F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}"))
    return side(0).join(side(1), ["contig", "nth"])


# contigs and files


CONTIGS = "c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS size, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM conversations)"


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("at", F.coalesce(before, F.lit(0)))


@query(f"""
WITH {CONTIGS}, p AS (SELECT conv_id, unnest(range(0, CAST(sum(size) AS BIGINT), 100)) AS pos FROM c GROUP BY conv_id)
SELECT p.conv_id, pos, max(turn) AS turn, pos - arg_max(first, turn) AS contig_pos FROM p JOIN c ON c.conv_id = p.conv_id AND first <= pos GROUP BY p.conv_id, pos
""")
def contig_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contig of every hundredth place: the last one that begins at or before it, by one sweep over contigs and places."""
    c = contigs(spark, sf_dir)
    total = c.groupBy("conv_id").agg(F.sum("size").alias("n")).where("n > 0")
    p = total.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(100).cast("long"))).alias("pos"))
    both = c.select("conv_id", F.col("at").alias("pos"), "turn", "at").unionByName(p.select("conv_id", "pos", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("at")))
    w = Window.partitionBy("conv_id").orderBy("pos", F.col("turn").asc_nulls_last())
    swept = both.withColumns({"own": F.last("turn", True).over(w), "begin": F.last("at", True).over(w)})
    return swept.where("turn IS NULL").select("conv_id", "pos", F.col("own").alias("turn"), (F.col("pos") - F.col("begin")).alias("contig_pos"))


@query(f"WITH {CONTIGS}, l AS (SELECT conv_id, role, arg_max(turn, turn) AS turn, arg_max(size, turn) AS size, min(turn) AS idx FROM c GROUP BY conv_id, role) SELECT conv_id, role, turn, size, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, idx) AS INTEGER) AS place FROM l")
def contigs_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A genome's contigs, longest first; of contigs with one header the last sequence counts, at the first one's place."""
    last = contigs(spark, sf_dir).groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.max_by("size", "turn").alias("size"), F.min("turn").alias("idx"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("size"), "idx"))).drop("idx")


@query("""
WITH i AS (SELECT 'genome' || conv_id AS stem, role || turn AS contig, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS idx, length(coalesce(text, '')) AS size FROM conversations)
SELECT stem, contig AS key, idx, size FROM i UNION ALL SELECT stem, CAST(idx AS VARCHAR), idx, size FROM i
""")
def sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input sequences under both their keys: genome and header, genome and number from 1."""
    c = load(spark, sf_dir, "conversations")
    i = c.select(F.concat(F.lit("genome"), F.col("conv_id")).alias("stem"), F.concat("role", "turn").alias("contig"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("idx"), F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return i.select("stem", F.explode(F.array("contig", F.col("idx").cast("string"))).alias("key"), "idx", "size")


@query("""
WITH r AS (SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang)
SELECT d.lang, d.doc_id, length(coalesce(text, '')) AS size, contains(coalesce(text, ''), '-') AS aligned FROM documents d JOIN r ON d.doc_id = r.doc_id
""")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each reference, and whether it holds gaps, as aligned sequences do."""
    d = load(spark, sf_dir, "documents").select("lang", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), F.contains(F.coalesce("text", F.lit("")), F.lit("-")).alias("aligned"))
    return d.groupBy("lang").agg(F.min(F.struct("doc_id", "size", "aligned")).alias("r")).select("lang", "r.*")


@query("SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS INTEGER) AS place FROM documents")
def shuffled_files(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """A reproducible random order of the final genomes of each language."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id")).cast("binary"))
    return load(spark, sf_dir, "documents").select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(h)).alias("place"))


# columns


@query(f"""
WITH {COLS}, n AS (SELECT set_id, col, ch, count(*) AS n FROM c WHERE ch <> '-' GROUP BY ALL)
SELECT set_id, col, string_agg(ch || n, '' ORDER BY n DESC, ch) AS counts FROM n GROUP BY set_id, col
""")
def letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each column, the commonest first."""
    n = C.profile(aln(spark, sf_dir))
    found = F.filter(F.array(*(F.struct((-F.col(f"n_{x.lower()}")).alias("k"), F.lit(x).alias("ch")) for x in "ACGTN")), lambda x: x["k"] < 0)
    return n.where("n_gap < n_seqs").select("set_id", "col", F.array_join(F.transform(F.array_sort(found), lambda x: F.concat(x["ch"], (-x["k"]).cast("string"))), "").alias("counts"))


@query(f"WITH {COLS} SELECT x.set_id, x.col, CAST(sum(CASE x.ch || y.ch {_SCORES} ELSE 0 END) AS BIGINT) AS score FROM c x JOIN c y ON x.set_id = y.set_id AND x.col = y.col AND y.seq_id < x.seq_id GROUP BY x.set_id, x.col")
def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of all pairs of letters in each column, from counts of letters instead of pairs of rows."""
    n = C.profile(aln(spark, sf_dir)).where("n_seqs > 1")
    held = lambda x: F.col(f"n_{x.lower()}")
    n_pairs = lambda a, b: held(a) * (held(a) - 1) / 2 if a == b else held(a) * held(b)
    total = sum((F.lit(v) * n_pairs(*k) for k, v in C.NUC_SCORES.items()), F.lit(0))
    return n.select("set_id", "col", total.cast("long").alias("score"))


@query(f"WITH {COLS} SELECT set_id, CAST(col // 200 AS INTEGER) AS win, min(col) AS first, max(col) AS last, count(*) FILTER (ch = '-') AS gaps FROM c GROUP BY set_id, win")
def column_windows(spark: SparkSession, sf_dir: str, size: int = 200) -> DataFrame:
    """Windows of columns that are refined one by one."""
    return cols(spark, sf_dir).groupBy("set_id", F.floor(F.col("col") / size).cast("int").alias("win")).agg(F.min("col").alias("first"), F.max("col").alias("last"), F.count_if(F.col("ch") == "-").alias("gaps"))


@query(f"WITH {IDENTITY} SELECT set_id, a, b, round(-ln(greatest(CAST(same AS DOUBLE) / n_both, 0.05)), 6) + 0.0 AS d FROM pr")
def log_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the logarithm of the identity, which counts as a twentieth at least."""
    return C.pair_identity(aln(spark, sf_dir)).select("set_id", "a", "b", (F.round(-F.log(F.greatest("identity", F.lit(0.05))), 6) + 0.0).alias("d"))


@query(f"WITH {ALN} SELECT set_id, seq_id, length(seq) AS width, length(replace(seq, '-', '')) AS bases FROM aln WHERE length(seq) > 25 AND length(replace(seq, '-', '')) >= 10")
def long_records(spark: SparkSession, sf_dir: str, columns: int = 25, least: int = 10) -> DataFrame:
    """Records that are written: of blocks of more than `columns` columns, and at least `least` bases."""
    bare = F.length(F.replace("seq", F.lit("-"), F.lit("")))
    return aln(spark, sf_dir).select("set_id", "seq_id", F.length("seq").alias("width"), bare.alias("bases")).where((F.col("width") > columns) & (F.col("bases") >= least))


@query(f"WITH {ALN} SELECT set_id, string_agg('>' || seq_id || chr(10) || seq || chr(10), '' ORDER BY seq_id) AS fasta FROM aln GROUP BY set_id")
def block_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTA text for each block."""
    record = F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), "seq", F.lit("\n")).alias("r")
    return aln(spark, sf_dir).groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_id", record))), lambda x: x["r"]), "").alias("fasta"))


@query(f"""
WITH s AS ({SHORT_SQL}), r AS (SELECT set_id, min(seq_id) AS ref_id FROM s GROUP BY set_id), f AS (SELECT r.set_id, ref_id, length(seq) AS n FROM r JOIN s ON seq_id = ref_id),
p AS (SELECT s.set_id, s.seq_id, s.seq_id = ref_id AS is_ref, seq, unnest(range(1, n + 1)) AS p, CASE WHEN s.seq_id = ref_id OR s.seq_id % 2 = 0 THEN 11 ELSE 13 END AS m FROM s JOIN f ON f.set_id = s.set_id),
w AS (SELECT set_id, p FROM p WHERE NOT is_ref AND p % m = 0 AND (seq_id + p) % 3 > 0 GROUP BY set_id, p)
SELECT p.set_id, seq_id, string_agg(rpad(substr(seq, p.p, 1), 1, '-') || CASE WHEN w.p IS NULL THEN '' WHEN NOT is_ref AND p.p % m = 0 AND (seq_id + p.p) % 3 > 0 THEN substr('ACGT', CAST((seq_id + p.p) % 4 + 1 AS BIGINT), 1) ELSE '-' END, '' ORDER BY p.p) AS seq
FROM p LEFT JOIN w ON w.set_id = p.set_id AND w.p = p.p GROUP BY p.set_id, seq_id
""")
def merged_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two alignments of each set with the set's first sequence as reference, of even and of odd sequences, with an insertion after every 11th and 13th base."""
    s = short_seqs(spark, sf_dir)
    first = s.groupBy("set_id").agg(F.min("seq_id").alias("ref_id"))
    n = s.join(first, "set_id").where("seq_id = ref_id").select("set_id", "ref_id", F.length("seq").alias("n")).where("n > 0")
    both = s.join(n, "set_id").withColumn("is_ref", F.col("seq_id") == F.col("ref_id")).withColumn("chunk", F.explode(F.when(F.col("is_ref"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("seq_id") % 2).cast("int")))))
    letter = lambda p: F.when(F.col("is_ref") | ((F.col("seq_id") + p) % 3 == 0), "-").otherwise(F.substring(F.lit("ACGT"), ((F.col("seq_id") + p) % 4 + 1).cast("int"), F.lit(1)))
    column = lambda p: F.concat(F.rpad(F.substring("seq", p, F.lit(1)), 1, "-"), F.when(p % (11 + 2 * F.col("chunk")) == 0, letter(p)).otherwise(""))
    rows = both.withColumn("row", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), column), ""))
    columns = rows.select("set_id", "chunk", "seq_id", "is_ref", F.posexplode(F.split("row", "(?!^)")).alias("col", "ch"))
    return merged_rows(columns)


# trees and lists


@query(f"""
WITH {TREE_SQL}, h AS (SELECT 'n' || n_nationkey AS node, max(l.len) AS height FROM leafs l JOIN nat ON c_nationkey = n_nationkey GROUP BY node
UNION ALL SELECT 'r' || n_regionkey, max(l.len + nat.len) FROM leafs l JOIN nat ON c_nationkey = n_nationkey GROUP BY n_regionkey UNION ALL SELECT 'root', max(l.len + nat.len + reg.len) FROM leafs l JOIN nat ON c_nationkey = n_nationkey JOIN reg ON n_regionkey = r_regionkey)
SELECT node, round(height, 6) AS height, CAST(row_number() OVER (ORDER BY round(height, 6), node) AS INTEGER) AS place FROM h
""")
def nodes_by_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal nodes with the longest way down to a leaf, the lowest first."""
    tree = hierarchy(spark, sf_dir)
    up = ancestors(tree, spark).join(tree.select("node", "parent"), "node")
    below = F.sum("length").over(Window.partitionBy("leaf").orderBy("depth"))
    heights = up.withColumn("height", below).groupBy(F.col("parent").alias("node")).agg(F.round(F.max("height"), 6).alias("height"))
    return heights.withColumn("place", F.row_number().over(Window.orderBy("height", "node")))  # one row an internal node


@query(f"WITH {MUMI} SELECT ref_id, query_id, 'genome' || query_id || '.fna,' || printf('%.6f', mumi) AS line FROM mu WHERE mumi < 0.5")
def recruited_lines(spark: SparkSession, sf_dir: str, most: float = 0.5) -> DataFrame:
    """Lines of the list of recruited genomes."""
    return mumi_rows(spark, sf_dir).where(F.col("mumi") < most).select("ref_id", "query_id", F.format_string("genome%d.fna,%.6f", "query_id", "mumi").alias("line"))


@query(f"""
WITH {IV}, {MERGED.format(k='contig')}, z AS (SELECT contig, max(e) + 25 AS size FROM iv GROUP BY contig), x AS (SELECT contig, s, e FROM m UNION ALL SELECT contig, size, size FROM z),
n AS (SELECT contig, coalesce(lag(e) OVER (PARTITION BY contig ORDER BY s, e), 0) AS a, s AS b FROM x) SELECT contig, '>' || contig || ':' || a || '-' || (b - 1) || ' +' AS line FROM n WHERE b - a >= 2
""")
def unaligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines of the regions that no cluster covers."""
    x = event_intervals(spark, sf_dir)
    gaps = I.complement(x, ["contig"], x.groupBy("contig").agg((F.max("end") + 25).alias("size")))
    return gaps.select("contig", F.format_string(">%s:%d-%d +", "contig", "start", F.col("end") - 1).alias("line"))
