"""The pipeline's stages against plain versions of their decisions."""

import sys

from conftest import DATA, same_rows
from test_operators import DOCS, frame, naive_hits, sample

import corpus_pipeline
from genomill.llm import queries

assert sys


def test_stages_keep_columns_and_follow_their_operators(spark):
    docs = frame(spark, sample()).cache()
    by = dict(corpus_pipeline.STAGES)
    kept = by["language_id"](spark, docs, DATA)
    assert kept.columns == DOCS.names and sorted(str(r.text) for r in kept.collect()) == sorted(str(r[1]) for r in sample() if any(c.isalpha() for c in r[1] or ""))
    first = by["near_duplicates"](spark, docs, DATA)
    texts = [r.text for r in first.collect()]
    assert first.columns == DOCS.names and len([t for t in texts if t == sample()[0][1]]) == 1
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    spiked = frame(spark, [*sample(), (900, "Before. " + bench[0][1], "en", "a", 1)])
    clean = by["decontamination"](spark, spiked, DATA)
    assert clean.columns == DOCS.names and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in sample() if not naive_hits(r[1], bench)[4])
    mixed = by["mixing"](spark, docs, DATA)
    assert mixed.columns == DOCS.names and mixed.count() > 0
    ids = by["token_ids"](spark, mixed, DATA)
    assert ids.count() == mixed.count()


def test_stages_keep_columns_of_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, sample()).withColumns({c: F.lit("own") for c in ("Score", "lang_pred", "items", "ranges", "n_words", "row", "tag", "key", "size", "copies", "contaminated")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {r.Score for r in out.collect()} == {"own"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_run_is_the_stages_in_turn(spark):
    """Rows of the whole run on the tables: every document that is left, as often as it is taken, with its ids."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-2]:
        docs = stage(spark, docs, DATA)
    left = {r.doc_id for r in docs.collect()}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, DATA).collect()
    times = {}
    for r in found:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= left and max(times.values()) <= 2
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert not [i for i in times if naive_hits(texts[i], bench)[4]]
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_stages_take_an_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, DATA)
        assert docs_out.count() == 0


def test_queries_with_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        same_rows(queries.queries()[name](spark, DATA), duck, sql)
