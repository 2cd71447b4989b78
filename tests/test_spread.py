"""Whole rows are shuffled once, into partitions that follow the input; what comes after finds them where they are."""

from conftest import DATA

from genomill.operators import columns as C
from genomill.plans.alignments import aln
from genomill.sources import scratch


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_partitions_follow_the_input(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART", 1_000)
    least = 10
    rows = aln(spark, DATA)
    assert least > 4 and rows.rdd.getNumPartitions() >= least
    assert C.anchors(rows).rdd.getNumPartitions() >= least


def test_sums_take_rows_of_a_group_where_they_are(spark):
    rows = spark.createDataFrame([(s, i, "ACGT-"[i:] + "ACGT-"[:i]) for s in range(5) for i in range(4)], "set_id long, seq_id long, seq string")
    by = rows.repartition(3, "set_id")
    assert shuffles(C.profile(by)) == 1 and shuffles(C.at_columns(by, C.is_snp)) <= 3
    assert sorted(map(tuple, C.profile(by).collect())) == sorted(map(tuple, C.profile(rows).collect()))


def test_letters_and_anchors(spark):
    rows = spark.createDataFrame([(1, 1, "ACGTACGTAC"), (1, 2, "ACGTACGTAC"), (1, 3, "ACG-ACGTAC"), (2, 4, "")], "set_id long, seq_id long, seq string")
    held = rows.selectExpr("*", "if(seq = '', array(), array(0, 3, 9)) as at")
    assert {r.seq_id: r.letters for r in C.letters_at(held).collect()} == {1: "ATC", 2: "ATC", 3: "A-C", 4: ""}
    assert sorted(tuple(r) for r in C.anchors(rows).collect()) == [(1, 4, 5), (1, 5, 6), (1, 6, None)]


def test_heavy_work_of_one_small_file_has_several_tasks_a_core(spark):
    from genomill.plans.matches import pairs
    from genomill.sources.scratch import HEAVY, spread

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    least = HEAVY * spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() < least <= spread(docs, "doc_id", heavy=True).rdd.getNumPartitions()
    assert pairs(spark, DATA).rdd.getNumPartitions() >= least


def test_cuts_that_failed_are_not_tried_again(monkeypatch):
    from genomill.operators import refine as R

    rows, tried = ["ACGTACGT", "ACGTACGT", "ACGTACGT"], []

    def path_rows(path, a, b):  # the first cut is accepted, no other
        tried.append(path)
        return [r + "-" * (len(tried) == 1) for r in a + b]

    monkeypatch.setattr(R, "path_rows", path_rows)
    monkeypatch.setattr(R, "cross_score", lambda own, *_: float(own[0].endswith("-")))
    tree, weights = R.tree_of(rows)
    assert R.refine(rows, tree, weights, 2)[1] == 1
    assert len(tried) == len(R.cuts(tree)) + 1  # in the second round only the cut that was accepted
