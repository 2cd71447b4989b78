"""SQL functions and streams."""

from pyspark.sql import functions as F

from genomill.functions.register import register
from genomill.streaming.composition import composition, fasta_stream, windowed_counts


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT reverse_complement('AACGTN') AS rc, gc_percent('GCAN') AS gc, fold_sequence('ab c') AS f, degap('A-C.') AS d, fragment_length(30111) AS n, msa(array('ACGT', 'AGT')) AS m").first()
    assert (r.rc, round(r.gc, 3), r.f, r.d, r.n) == ("NACGTT", 66.667, "ACNG", "AC", 500)
    assert [x.replace("-", "") for x in r.m] == ["ACGT", "AGT"] and len({len(x) for x in r.m}) == 1


def test_fasta_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x one\nACG\nNN\n>y\nTT\n")
    q = composition(fasta_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("composed").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("composed").collect())) == [("x", 5, 2, 2), ("y", 2, 0, 0)]


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in windowed_counts(e, "t", "k").collect()) == [1, 2]
