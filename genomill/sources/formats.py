"""Readers of the text formats: each takes text that Spark has read (column value, or whole texts) and gives rows.

`read_*` functions take paths in any store; the parsers beside them work on DataFrames and so on streams too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from genomill.operators.tallies import text_of


def expand_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, stem: folders give their files, .txt manifests one path a line, other files themselves."""
    manifests = [p for p in paths if p.endswith(".txt")]
    found = spark.read.format("binaryFile").load([p for p in paths if p not in manifests]).select("path") if len(manifests) < len(paths) else None
    for m in manifests:
        lines = spark.read.text(m).select(F.trim("value").alias("path")).where("path <> ''")
        found = lines if found is None else found.unionByName(lines)
    return found.select("path", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"))


def fasta_records(texts: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """name (up to the first blank), description, seq (lines joined) of every record of whole texts, with its number from 1."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col(text)), "\n>"), lambda p: F.trim(p) != "")
    rows = texts.select(*keep, F.posexplode(parts).alias("i", "r"))
    header = F.regexp_extract("r", r"^([^\n]*)", 1)
    return rows.select(*keep, (F.col("i") + 1).alias("idx"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), F.trim(F.regexp_replace(header, r"^\S*", "")).alias("description"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"))


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    return fasta_records(spark.read.text(list(paths), wholetext=True).withColumn("path", F.input_file_name()), "value", "path")


def genbank_records(texts: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """name (of the first line with GI), seq: the bases between ORIGIN and //, upper-case, without numbers and blanks."""
    value = F.col(text)
    origin = F.regexp_extract(value, r"(?s)\nORIGIN[^\n]*\n(.*?)(?:\n//|\z)", 1)
    return texts.select(*keep, F.trim(F.regexp_extract(value, r"([^\n]*GI[^\n]*)", 1)).alias("name"), F.upper(F.regexp_replace(origin, r"[\d\s]", "")).alias("seq"))


XMFA_HEADER = r"##SequenceIndex (\d+)\n##SequenceFile ([^\n]*)\n##SequenceHeader >?([^\n]*)\n##SequenceLength (\d+)bp"
XMFA_RECORD = r"^\s*(\d+):(\d+)-(\d+) ([+-]) cluster(\d+) s(\d+):p(\d+)"


def xmfa_headers(texts: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """idx, file, header, length of every sequence that the head of a file lists."""
    entries = F.regexp_extract_all(F.col(text), F.lit(XMFA_HEADER), 0)
    rows = texts.select(*keep, F.explode(entries).alias("e"))
    part = lambda i: F.regexp_extract("e", XMFA_HEADER, i)
    return rows.select(*keep, part(1).cast("int").alias("idx"), part(2).alias("file"), part(3).alias("header"), part(4).cast("long").alias("length"))


def xmfa_records(texts: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """cluster, idx, start, end, strand, contig_idx, contig_pos, seq of every aligned record; blocks end with '='."""
    blocks = texts.select(*keep, F.explode(F.split(F.regexp_replace(F.col(text), r"(?m)^#[^\n]*\n", ""), "\n=")).alias("block"))
    rows = blocks.select(*keep, F.explode(F.split(F.concat(F.lit("\n"), F.col("block")), "\n>")).alias("r")).where(F.col("r").rlike(XMFA_RECORD))
    part = lambda i: F.regexp_extract("r", XMFA_RECORD, i)
    return rows.select(
        *keep, part(5).cast("int").alias("cluster"), part(1).cast("int").alias("idx"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), F.when(part(4) == "+", 1).otherwise(-1).alias("strand"),
        part(6).cast("int").alias("contig_idx"), part(7).cast("long").alias("contig_pos"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*", ""), r"\s", "").alias("seq"),
    )


def maf_records(lines: DataFrame) -> DataFrame:
    """src, start, size, strand, src_size, text of the s lines."""
    f = F.split("value", r"\s+")
    return lines.where(F.col("value").startswith("s ")).select(f[1].alias("src"), f[2].cast("long").alias("start"), f[3].cast("long").alias("size"), f[4].alias("strand"), f[5].cast("long").alias("src_size"), f[6].alias("text"))


def mumi_rows(lines: DataFrame) -> DataFrame:
    f = F.split("value", ":")
    return lines.where(F.col("value").rlike(r"^\d+:[\d.]+$")).select(f[0].cast("int").alias("idx"), f[1].cast("double").alias("mumi"))


def mash_rows(lines: DataFrame) -> DataFrame:
    """file, dist: rows whose distance isn't empty; the head line has no number."""
    f = F.split("value", "\t", -1)
    return lines.where(F.try_element_at(f, F.lit(2)).rlike(r"^[\d.eE+-]+$")).select(f[0].alias("file"), f[1].cast("double").alias("dist"))


def ani_rows(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 5).select(f[0].alias("query"), f[1].alias("ref"), f[2].cast("double").alias("ani"), f[3].cast("int").alias("matched"), f[4].cast("int").alias("total"))


def profile_rows(lines: DataFrame) -> DataFrame:
    """pos, p of a recombination profile; lines that aren't two numbers are passed over."""
    f = F.split("value", ",")
    return lines.where(F.col("value").rlike(r"^\s*\d+\s*,\s*[\d.eE+-]+\s*$")).select(F.trim(f[0]).cast("long").alias("pos"), F.trim(f[1]).cast("double").alias("p"))


def log_totals(lines: DataFrame) -> DataFrame:
    """coverage, length: the total coverage line and the sum of all lengths of a run's log."""
    share = F.regexp_extract("value", r"Total coverage among all sequences:\s*([\d.]+)", 1)
    length = F.regexp_extract("value", r"Length:\s*(\d+)", 1)
    return lines.select(F.when(share != "", share.cast("double")).alias("c"), F.when(length != "", length.cast("long")).alias("n")).agg(F.max("c").alias("coverage"), F.sum("n").alias("length"))


def anchor_rows(lines: DataFrame, n: int) -> DataFrame:
    """starts, length of anchor files: two head lines, a record every n + 1 lines, starts parted by two blanks. lines: at (from 0), value."""
    f = F.split(F.trim("value"), r"\s{2,}|\s+")
    return lines.where((F.col("at") >= 2) & ((F.col("at") - 2) % (n + 1) == 0)).select(F.slice(f, 1, n).try_cast("array<long>").alias("starts"), F.element_at(f, -1).try_cast("int").alias("length"))


def ini_rows(lines: DataFrame) -> DataFrame:
    """section, key, value; sections and keys in lower case; comments go. lines: at (order), value."""
    section = F.last(F.when(F.col("value").rlike(r"^\s*\[.*\]"), F.lower(F.regexp_extract("value", r"\[(.*?)\]", 1))), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    kv = r"^\s*([^=;#\[]+?)\s*=\s*(.*?)\s*$"
    return lines.withColumn("section", section).where(F.col("value").rlike(kv)).select("file", "section", F.lower(F.regexp_extract("value", kv, 1)).alias("key"), F.regexp_extract("value", kv, 2).alias("value"))


def score_matrix_rows(text: DataFrame) -> DataFrame:
    """a, b, score from a square table with letters above and before it."""
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    head = F.split(F.trim(F.element_at(lines, 1)), r"\s+")
    rows = text.select(head.alias("head"), F.explode(F.slice(lines, F.lit(2), F.size(lines) - 1)).alias("row")).withColumn("f", F.split(F.trim("row"), r"\s+"))
    return rows.select(F.col("f")[0].alias("a"), F.posexplode("head").alias("i", "b"), "f").select("a", "b", F.get("f", F.col("i") + 1).cast("double").alias("score"))


_NEWICK = re.compile(r"\s*('(?:[^']|'')*'|[^\s(),:;']+|[(),:;])")


def newick_nodes(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, name, edge length), the root is node 0; a parser with one stack."""
    nodes: list[list] = [[0, None, None, None]]
    at = 0
    tokens = _NEWICK.findall(text)
    k = 0
    while k < len(tokens) and tokens[k] != ";":
        t = tokens[k]
        if t == "(":
            nodes.append([len(nodes), at, None, None])
            at = len(nodes) - 1
        elif t == ",":
            nodes.append([len(nodes), nodes[at][1], None, None])
            at = len(nodes) - 1
        elif t == ")":
            at = nodes[at][1]
        elif t == ":":
            k += 1
            nodes[at][3] = float(tokens[k])
        else:
            nodes[at][2] = t[1:-1].replace("''", "'") if t[0] == "'" else t
        k += 1
    return [tuple(n) for n in nodes]


def newick_rows(texts: DataFrame, text: str, key: str) -> DataFrame:
    """key, node, parent, name, edge_len of every tree."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, *n) for k, t in zip(pdf["k"], pdf["t"], strict=True) for n in newick_nodes(t)]
            yield pd.DataFrame(rows, columns=["key", "node", "parent", "name", "edge_len"]).astype({"parent": "Int64"})

    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"key {kind}, node long, parent long, name string, edge_len double").withColumnRenamed("key", key)


EDGES = ArrayType(StructType([StructField("op", StringType()), StructField("pa", IntegerType()), StructField("pb", IntegerType())]))
#: Edges made at once, some 17 bytes each, beside those of the last path.
SENT = 1 << 20


def _edges(paths: pa.Array) -> pa.ListArray:
    """The edges of each path as one run of numbers, null where the path is null."""
    ops, at = text_of(paths)
    sums = []
    for own in (b"MD", b"MI"):
        total = np.cumsum(np.isin(ops, list(own)), dtype=np.int64)
        before = np.append(0, total)[at[:-1]]
        sums.append(pa.array((total - np.repeat(before, np.diff(at))).astype(np.int32)))
    letters = pa.StringArray.from_buffers(len(ops), pa.py_buffer(np.arange(len(ops) + 1, dtype=np.int32)), pa.py_buffer(ops.tobytes()))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([letters, *sums], names=["op", "pa", "pb"]), mask=paths.is_null())


@F.arrow_udf(EDGES)
def path_edges(path: pa.Array) -> pa.Array:
    """A path string of M, D, I as (op, prefix in a, prefix in b), in time that grows with its length. All edges of a batch are held; `edges_of` holds a part."""
    return _edges(path)


def edge_batches(batches: Iterator[pa.RecordBatch], path: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """keep.., edges: the rows of each batch in parts of some `SENT` edges."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(path)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(batch):
            done = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, done + SENT, "right")), first + 1)
            rows = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), _edges(rows.column(path))], names=[*keep, "edges"])
            first = last


def edges_of(paths: DataFrame, path: str, *keep: str) -> DataFrame:
    """keep.., edges: `path_edges` of every row. A task holds some `SENT` edges at once however many rows a batch has."""
    kinds = "".join(f"{c} {paths.schema[c].dataType.simpleString()}, " for c in keep)
    return paths.select(*keep, path).mapInArrow(lambda batches: edge_batches(batches, path, list(keep)), f"{kinds}edges {EDGES.simpleString()}")
