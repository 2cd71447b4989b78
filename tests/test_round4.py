"""What a review found: rows that failed, were cut off or were wrong."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import DATA
from genomill.operators import intervals as I
from genomill.operators import matches as M
from genomill.operators import rooting as R
from genomill.sources.formats import path_edges
from genomill.sources.writers import fixed


def test_a_sequence_without_bases_is_far(spark):
    matches = spark.createDataFrame([(1, 2, 0, 8)], "ref_id long, query_id long, ref_start long, length long")
    sizes = spark.createDataFrame([(1, 10, 2, 10), (1, 10, 3, 0), (4, 0, 5, 0), (4, 0, 6, 7)], "ref_id long, ref_len int, query_id long, query_len int")
    got = {(r.ref_id, r.query_id): r.mumi for r in M.mumi(matches, sizes).collect()}
    assert got == pytest.approx({(1, 2): 0.2, (1, 3): 1.0, (4, 5): 1.0, (4, 6): 1.0})


def test_trees_of_more_rows_than_a_recursive_query_may_have(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        leaves = [(f"c{i}", f"n{i % 4}", 1.0 + i % 7, True) for i in range(100)]
        tree = spark.createDataFrame([*leaves, *((f"n{i}", "root", 2.0, False) for i in range(4))], "node string, parent string, length double, leaf boolean")
        assert R.upward(tree).count() == 200
        edges = {r.node: r for r in R.edge_distances(tree, spark).collect()}
        assert len(edges) == 104 and edges["c0"].n_up == 99 and edges["n1"].n == 25
        assert R.pruned(tree, tree.where("leaf").select("node"), spark).count() == 104
        assert entry.queries()["tree_heights"](spark, DATA).count() > 50
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_equal_intervals_share_an_island(spark):
    rows = [("a", s, s + 3) for s in (0, 0, 0, 40, 40, 50) for _ in range(50)]
    x = spark.createDataFrame(rows, "k string, start long, end long").repartition(4)
    assert sorted(map(tuple, I.merged(x, ["k"]).collect())) == [("a", 0, 3), ("a", 40, 43), ("a", 50, 53)]


def test_numbers_are_rounded_from_their_binary_value(spark):
    values = [5.4265, 6.8255, 8.5055, 1.3295, 9.8355, 0.0005, 2.0, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(fixed("v", F.lit(3))).collect()
    assert [r[0] for r in got] == [None if v is None else f"{v:.3f}" for v in values] and got[0][0] == "5.426"


def test_edges_of_long_paths(spark):
    got = spark.createDataFrame([("MDI" * 100_000,), ("",), (None,)], "p string").select(path_edges("p").alias("e")).select(F.size("e").alias("n"), F.expr("try_element_at(e, -1)").alias("e")).collect()
    assert (got[0].n, got[0].e.op, got[0].e.pa, got[0].e.pb) == (300_000, "I", 200_000, 200_000)
    assert got[1].n == 0 and got[2].e is None
