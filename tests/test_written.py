"""Core-genome files: what a record says is where its letters stand, no reference symbol is written twice, gaps count as columns only."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from genomill.operators import written as O
from genomill.plans import written as P
from genomill.plans.matches import bases

RC = str.maketrans("ACGTU", "TGCAA")


@pytest.fixture(scope="module")
def records(spark):
    return P.core_genome_records(spark, DATA).collect()


def test_letters_stand_where_the_record_says(spark, records):
    seq = {r.seq_id: r.seq for r in bases(spark, DATA).collect()}
    assert records and {r.strand for r in records} == {1, -1}
    for r in records:
        own = seq[r.ref_id if r.idx == 1 else r.query_id][r.start - 1 : r.end]
        assert r.seq.upper() == (own if r.strand == 1 else own.translate(RC)[::-1])
        assert len(r.seq) > P.LEAST


def test_small_letters_agree_and_capitals_lie_between(records):
    rows = {}
    for r in records:
        rows.setdefault((r.ref_id, r.query_id, r.cluster), {})[r.idx] = r.seq
    assert any(x[1] != x[1].lower() for x in rows.values())
    for x in rows.values():
        assert all((a == b) if a.islower() else b.isupper() for a, b in zip(x[1], x[2], strict=True))


def test_no_reference_symbol_is_written_twice(records):
    last = {}
    for r in sorted((r for r in records if r.idx == 1), key=lambda r: r.cluster):
        assert r.start > last.get((r.ref_id, r.query_id), 0)
        last[r.ref_id, r.query_id] = r.end


def test_places_on_contigs(spark, records):
    offsets = {r.seq_id: r.offsets for r in P.genomes(spark, DATA).collect()}
    assert any(r.contig_idx > 1 for r in records)
    for r in records:
        at = offsets[r.ref_id if r.idx == 1 else r.query_id]
        place = r.start - 1 if r.strand == 1 else r.end
        assert r.contig_pos == place - at[r.contig_idx - 1] + (r.contig_idx == 1)
        assert r.strand == -1 or max(i for i, o in enumerate(at, 1) if o < r.start) == r.contig_idx


def naive_trim(row, other, bases_to_cut):
    cut = 0
    while bases_to_cut and cut < len(row):
        bases_to_cut -= row[cut] != "-"
        cut += 1
    return row[cut:], other[cut:], len(row[:cut].replace("-", "")), len(other[:cut].replace("-", ""))


def test_trimming_counts_reference_symbols_and_not_gaps(spark):
    rows = [
        (1, 2, 0, 8, 1, "ACGT-ACGT", "ACGTTAC-T"), (1, 2, 5, 12, 2, "--CGT-ACGT", "GGC-TTACGT"), (1, 2, 6, 9, 3, "ACG", "ACG"), (1, 2, 10, 20, 4, "ACGTACGTAC", "ACGTACGTAC"),
        (1, 3, 5, 12, 1, "ACGTACG", "ACGTACG"), (1, 4, 0, 3, 1, "ACG", "ACG"), (1, 4, 1, 9, 2, "CGTACGTA", "CGTACGTA"), (1, 5, 0, 10, 1, "ACGTACGTAC", "ACGTACGTAC"), (1, 5, 3, 9, 2, "TACGTA", "TACGTA"),
    ]
    blocks = spark.createDataFrame(rows, "ref_id long, query_id long, start long, end long, cluster int, ref_row string, query_row string")
    got = {(r.query_id, r.cluster): (r.ref_row, r.query_row, r.lost_ref, r.lost_query) for r in O.trimmed(blocks, 3).collect()}
    want, ends = {}, {}
    for _, q, start, end, z, a, b in rows:
        if len(a) > 3:  # a narrow block takes no reference symbol from others
            done = naive_trim(a, b, max(0, ends.get(q, 0) - start))
            ends[q] = max(ends.get(q, 0), end)
            if len(done[0]) > 3:
                want[q, z] = done
    assert got == want and (4, 2) in got and (5, 2) not in got and got[2, 2][2] == 3


def test_files_without_blocks_and_empty_tables(spark):
    genomes = spark.createDataFrame([(1, 4, [0], "a", "h"), (2, 0, [], "b", "h"), (3, 0, None, "c", None)], "seq_id long, size long, offsets array<long>, file string, header string")
    pairs = spark.createDataFrame([(1, "ACGT", 2, ""), (1, "ACGT", 3, "")], "ref_id long, ref_seq string, query_id long, seq string")
    none = spark.createDataFrame([], "ref_id long, query_id long, fwd boolean, ref_start long, query_start long, length long")
    got = O.core_files(O.diagonal_blocks(none, pairs, 20), pairs, genomes, 20).collect()
    assert len(got) == 2 and all(r.written == 0 and r.text.endswith("#IntervalCount 0\n") for r in got)
    assert O.core_files(O.diagonal_blocks(none, pairs.limit(0), 20), pairs.limit(0), genomes, 20).count() == 0


def test_columns_of_bases(spark):
    df = spark.createDataFrame([("--AC-G", 0), ("--AC-G", 1), ("--AC-G", 2), ("--AC-G", 3), ("--AC-G", 9), ("", 1)], "row string, n long")
    assert [r[0] for r in df.select(O.columns_of_bases(F.col("row"), F.col("n"))).collect()] == [0, 3, 4, 6, 6, 0]
