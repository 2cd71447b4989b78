"""Formats written and read back: the rows must come through unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomill.operators.columns import marks
from genomill.plans.alignments import ALN, aln
from genomill.plans.registry import load, query
from genomill.sources import formats as R
from genomill.sources import writers as W
from genomill.sources.sequences import SEQS_SQL, seqs


@query(f"WITH s AS ({SEQS_SQL}) SELECT source, 'seq' || seq_id AS name, length(seq) AS size, md5(seq) AS seq_md5 FROM s")
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqs(spark, sf_dir)
    texts = s.select("source", W.fasta_text(F.format_string("seq%d from %s", "seq_id", "lang"), F.col("seq")).alias("value"))
    return R.fasta_records(texts, "value", "source").select("source", "name", F.length("seq").alias("size"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))




def xmfa_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = aln(spark, sf_dir).withColumns({"bases": F.length(F.replace(F.col("seq"), F.lit("-"), F.lit(""))), "strand": F.when(F.col("seq_id") % 3 == 0, -1).otherwise(1)})
    c = F.col
    record = W.xmfa_record_text(c("seq_id") + 1, c("seq_id") * 1000 + 1, c("seq_id") * 1000 + c("bases"), c("strand"), c("set_id"), c("seq_id") % 2 + 1, c("seq_id") % 100 * 10, c("seq"))
    return W.xmfa_text(a.withColumn("record", record), "seq_id", "record", "set_id")


@query(f"""
WITH {ALN} SELECT CAST(set_id AS INTEGER) AS cluster, CAST(seq_id + 1 AS INTEGER) AS idx, seq_id * 1000 + 1 AS start, seq_id * 1000 + length(replace(seq, '-', '')) AS "end", CASE WHEN seq_id % 3 = 0 THEN -1 ELSE 1 END AS strand,
  CAST(seq_id % 2 + 1 AS INTEGER) AS contig_idx, seq_id % 100 * 10 AS contig_pos, seq FROM aln
""")
def xmfa_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.xmfa_records(xmfa_blocks(spark, sf_dir), "block")


@query("SELECT CAST(doc_id + 1 AS INTEGER) AS idx, source || '.fna' AS file, lang || ' ' || doc_id AS header, length(text) AS length FROM documents")
def xmfa_header_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("idx"), F.concat("source", F.lit(".fna")).alias("file"), F.concat_ws(" ", "lang", "doc_id").alias("header"), F.length("text").alias("length"))
    return R.xmfa_headers(d.select(W.xmfa_header_text(*map(F.col, d.columns)).alias("value")))


@query(f"""
WITH {ALN}, n AS (SELECT set_id, seq_id % 2 + 1 AS contig, sum(length(replace(seq, '-', ''))) + 20000 AS size FROM aln GROUP BY ALL)
SELECT 'set' || aln.set_id || '#' || contig AS src, CASE WHEN seq_id % 3 = 0 THEN CAST(n.size AS BIGINT) - seq_id % 100 * 10 ELSE seq_id % 100 * 10 END AS start, length(replace(seq, '-', '')) AS size,
  CASE WHEN seq_id % 3 = 0 THEN '-' ELSE '+' END AS strand, CAST(n.size AS BIGINT) AS src_size, seq AS text FROM aln JOIN n ON n.set_id = aln.set_id AND n.contig = seq_id % 2 + 1
""")
def maf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as MAF lines; a contig is as long as its records together and 20,000 bases more, found by a join on its name."""
    r = R.xmfa_records(xmfa_blocks(spark, sf_dir), "block")
    bases = F.length(F.replace(F.col("seq"), F.lit("-"), F.lit("")))
    contigs = aln(spark, sf_dir).groupBy(F.col("set_id").cast("int").alias("cluster"), (F.col("seq_id") % 2 + 1).cast("int").alias("contig_idx")).agg((F.sum(bases) + 20000).alias("size"))
    line = W.maf_line(F.concat(F.lit("set"), F.col("cluster").cast("string")), F.col("contig_idx").cast("string"), F.col("contig_pos"), F.col("strand"), F.col("size"), F.col("seq"))
    return R.maf_records(r.join(contigs, ["cluster", "contig_idx"]).select(line.alias("value")))


@query(f"WITH s AS ({SEQS_SQL}) SELECT seq_id, 'VERSION     ' || seq_id || '  GI:' || seq_id AS name, md5(seq) AS seq_md5 FROM s")
def genbank_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = seqs(spark, sf_dir).select("seq_id", W.genbank_text(F.col("seq_id").cast("string"), F.col("seq")).alias("value"))
    return R.genbank_records(texts, "value", "seq_id").select("seq_id", "name", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query(f"WITH {ALN} SELECT set_id, count(*) || ' ' || max(length(seq)) || chr(10) || string_agg(rpad(CAST(seq_id AS VARCHAR), 10, ' ') || seq, chr(10) ORDER BY seq_id) AS text FROM aln GROUP BY set_id")
def phylip_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.phylip_text(aln(spark, sf_dir))


@query()
def clustal_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.clustal_text(aln(spark, sf_dir), marks(aln(spark, sf_dir)))


@query(f"""
WITH {ALN} SELECT set_id, seq_id, ' Name: ' || seq_id || '  Len: ' || length(seq) || '  Check: ' || CAST(list_sum([(i % 57 + 1) * ord(seq[i + 1]) FOR i IN range(0, length(seq))]) % 10000 AS BIGINT) || '  Weight: 1.00' AS line FROM aln
""")
def msf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from genomill.plans.alignments import gcg_checksum

    a = aln(spark, sf_dir).join(gcg_checksum(spark, sf_dir), ["set_id", "seq_id"])
    return a.select("set_id", "seq_id", W.msf_line(F.col("seq_id").cast("string"), F.length("seq"), F.col("checksum")).alias("line"))


@query("SELECT CAST(event_id % 1000 AS INTEGER) AS idx, CAST(printf('%.6f', value / 1000) AS DOUBLE) AS mumi FROM events")
def mumi_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mumi_rows(load(spark, sf_dir, "events").select(F.format_string("%d:%f", F.col("event_id") % 1000, F.col("value") / 1000).alias("value")))


@query("SELECT url AS file, page_id / 4.0::DOUBLE AS dist FROM pages WHERE page_id % 3 <> 0")
def mash_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("\t", "url", F.when(F.col("page_id") % 3 == 0, "").otherwise((F.col("page_id") / 4.0).cast("string")))
    return R.mash_rows(load(spark, sf_dir, "pages").select(value.alias("value")))


@query("SELECT 'q' || l_orderkey AS query, 'r' || l_suppkey AS ref, 90 + l_discount * 100 AS ani, CAST(l_quantity AS INTEGER) AS matched, 50 AS total FROM lineitem")
def ani_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat_ws("\t", F.concat(F.lit("q"), F.col("l_orderkey").cast("string")), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")), (90 + F.col("l_discount") * 100).cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("50"))
    return R.ani_rows(load(spark, sf_dir, "lineitem").select(value.alias("value")))


@query("SELECT event_id AS pos, value AS p FROM events WHERE event_type <> 'error'")
def profile_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "error", "bad line").otherwise(F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")))
    return R.profile_rows(load(spark, sf_dir, "events").select(value.alias("value")))


@query("SELECT CAST(printf('%.1f', max(s_acctbal) / 100) AS DOUBLE) AS coverage, (SELECT CAST(sum(p_size) AS BIGINT) FROM part) AS length FROM supplier")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and coverages among other lines of a run's log."""
    lines = load(spark, sf_dir, "part").select(F.format_string("  Length: %d bps", F.col("p_size")).alias("value"))
    other = load(spark, sf_dir, "supplier").select(F.format_string("Total coverage among all sequences: %.1f%%", F.greatest(F.col("s_acctbal") / 100, F.lit(0.0))).alias("value"))
    return R.log_totals(lines.unionByName(other).unionByName(load(spark, sf_dir, "nation").select(F.concat(F.lit("reading "), "n_name").alias("value"))))


@query("SELECT [c_custkey, c_custkey * 2, CAST(c_nationkey AS BIGINT)] AS starts, 20 + c_nationkey AS length FROM customer")
def anchor_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    record = F.concat_ws("  ", *(x.cast("string") for x in (F.col("c_custkey"), F.col("c_custkey") * 2, F.col("c_nationkey"), 20 + F.col("c_nationkey"))))
    lines = c.select((2 + 4 * F.col("c_custkey")).alias("at"), record.alias("value")).unionByName(c.select((3 + 4 * F.col("c_custkey")).alias("at"), F.lit("AC").alias("value")))
    return R.anchor_rows(lines, 3)


@query("SELECT r_name AS file, 'lcb' AS section, 'd' AS key, CAST(r_regionkey AS VARCHAR) AS value FROM region UNION ALL SELECT r_name, 'mum', 'factor', '2.0' FROM region")
def ini_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array(F.lit("; settings"), F.lit("[LCB]"), F.concat(F.lit("D = "), F.col("r_regionkey").cast("string")), F.lit("[MUM]"), F.lit("factor=2.0"))
    return R.ini_rows(load(spark, sf_dir, "region").select(F.col("r_name").alias("file"), F.posexplode(text).alias("at", "value")))


@query("""
SELECT DISTINCT 'L' || x.p_size AS a, 'L' || y.p_size AS b, CAST(x.p_size * 100 - y.p_size AS DOUBLE) / 4 AS score FROM (SELECT DISTINCT p_size FROM part) x, (SELECT DISTINCT p_size FROM part) y
""")
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square table of scores between the part sizes, written as text with a comment and read back."""
    sizes = load(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))  # as many as there are sizes, not parts
    head = F.concat(F.lit("     "), F.array_join(F.transform("sizes", lambda x: F.format_string("L%d", x)), "  "))
    line = lambda x: F.concat(F.format_string("L%d ", x), F.array_join(F.transform("sizes", lambda y: ((x * 100 - y) / 4).cast("string")), " "))
    return R.score_matrix_rows(sizes.select(F.concat(F.lit("# scores\n"), head, F.lit("\n"), F.array_join(F.transform("sizes", line), "\n")).alias("value")))


@query("""
SELECT r_name AS file, n_name AS name, r_name AS above, 1.0 + n_nationkey % 5 AS edge_len FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 'c' || c_custkey, n_name, CAST(printf('%.3f', abs(c_acctbal) / 1000) AS DOUBLE) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, r_name, NULL, NULL FROM region
""")
def newick_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree text for each region, of its nations and their customers, read back: every node with its name, edge and the node above."""
    t = lambda n: load(spark, sf_dir, n)
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    leaves = t("customer").withColumn("length", W.fixed(F.abs("c_acctbal") / 1000, F.lit(3))).groupBy("c_nationkey").agg(joined(F.format_string("c%d:%s", "c_custkey", "length")).alias("below"))
    nations = t("nation").join(leaves, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    inner = F.concat(F.when(F.col("below").isNull(), "").otherwise(F.concat(F.lit("("), "below", F.lit(")"))), quoted("n_name"), F.lit(":"), (1 + F.col("n_nationkey") % 5).cast("double").cast("string"))
    regions = nations.groupBy("n_regionkey").agg(joined(inner).alias("below")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = regions.select(F.col("r_name").alias("file"), F.concat(F.lit("("), "below", F.lit(")"), quoted("r_name"), F.lit(";")).alias("newick"))
    rows = R.newick_rows(texts, "newick", "file")
    above = rows.select("file", F.col("node").alias("parent"), F.col("name").alias("above"))
    return rows.join(above, ["file", "parent"], "left").select("file", "name", "above", "edge_len")


@query("""
WITH b AS (SELECT event_type AS chrom, CAST(floor(value * 10) AS BIGINT) AS s, value / 100 AS p FROM events)
SELECT chrom || chr(9) || s || chr(9) || (s + 100) || chr(9) || 'REC' || chr(9) || printf('%.5f', p) || chr(9) || '+' AS line FROM b
""")
def bed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.col("value") * 10)
    return load(spark, sf_dir, "events").select(W.bed_line(F.col("event_type"), s, s + 100, F.col("value") / 100).alias("line"))


@query(f"WITH {ALN} SELECT seq_id, length(seq) AS n_edges, length(seq) - length(replace(seq, '-', '')) AS pa, length(replace(seq, '-', '')) AS pb FROM aln")
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from rows of alignments: a gap is a step in a alone, a letter a step in b alone."""
    path = F.translate("seq", "-NACGT", "DIIIII")
    e = R.edges_of(aln(spark, sf_dir).select("seq_id", path.alias("path")), "path", "seq_id")
    last = lambda c: F.coalesce(F.try_element_at("edges", F.lit(-1))[c], F.lit(0)).alias(c)
    return e.select("seq_id", F.size("edges").alias("n_edges"), last("pa"), last("pb"))
