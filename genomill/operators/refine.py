"""Refinement: an alignment is cut in two along each edge of its tree, the halves are aligned anew, and what scores better stays."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomill.operators.dp import GAP, alone, letters, path_rows, texts, together
from genomill.operators.objectives import scores_beside
from genomill.operators.trees import Tree, kmer_distance_matrix, leaf_weights, upgma
from genomill.sources.scratch import spread, stash

#: Most rounds over all edges; a round without a change ends it earlier.
ROUNDS = 8
#: Groups of rows that a task gives back at once.
SENT = 256


def bare_columns(rows: list[str]) -> list[str]:
    """The rows without the columns in which all have a gap."""
    codes = letters(rows)
    return texts(codes[:, (codes != GAP).any(axis=0)])


def cross_score(rows: list[str], one: list[int], two: list[int], weights: np.ndarray) -> float:
    """Weighted score of all pairs between two groups of rows. What a cut can change is only this part of the sum over all pairs."""
    codes = np.minimum(letters(rows), 255).astype(np.uint8)
    return float(sum(weights[i] * (weights[two] * scores_beside(codes[i], codes[two])).sum() for i in one))


def cuts(tree: Tree) -> list[list[int]]:
    """The leaves on one side of every edge, inner nodes in order of height: first those of right children, then those of left ones; the root's edge counts once."""
    inner = sorted(range(tree.n, tree.root + 1), key=lambda v: (tree.height[v], v))
    return [tree.leaves(tree.children[v - tree.n][side]) for side in (1, 0) for v in inner if side or v != tree.root]


def refining(rows: list[str], tree: Tree, weights: np.ndarray, rounds: int = ROUNDS) -> Generator[tuple, str, tuple[list[str], int]]:
    """The refined rows and how many cuts were accepted; asks for the best path of the two sides of a cut."""
    accepted = 0
    if len(rows) < 3:
        return rows, 0
    failed: set[tuple[int, ...]] = set()  # cuts that gain nothing with the rows as they are
    for r in range(rounds):
        changed = False
        edges = cuts(tree)
        for one in edges if r % 2 == 0 else edges[::-1]:
            if tuple(one) in failed:
                continue
            inside = set(one)
            two = [i for i in range(len(rows)) if i not in inside]
            a, b = bare_columns([rows[i] for i in one]), bare_columns([rows[i] for i in two])
            if not a[0] or not b[0]:
                continue
            path = yield (a, weights[one]), (b, weights[two])
            fresh = path_rows(path, a, b)
            new = [""] * len(rows)
            for i, row in zip(one + two, fresh, strict=True):
                new[i] = row
            if new != rows and cross_score(new, one, two, weights) > cross_score(rows, one, two, weights) + 1e-9:
                rows, changed, accepted = new, True, accepted + 1
                failed.clear()
            else:
                failed.add(tuple(one))
        if not changed:
            break
    return rows, accepted


def refine(rows: list[str], tree: Tree, weights: np.ndarray, rounds: int = ROUNDS) -> tuple[list[str], int]:
    """The refined rows and how many cuts were accepted; their bare sequences stay, the weighted sum over pairs never falls."""
    return alone(refining(rows, tree, weights, rounds))


def tree_of(rows: list[str]) -> tuple[Tree, np.ndarray]:
    """Tree and weights from the k-mers of the bare rows; as in the alignment itself. Weights of empty rows are made from their places in the tree too."""
    tree = upgma(kmer_distance_matrix([r.replace("-", "") for r in rows]))
    return tree, leaf_weights(tree)


def groups_of(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, which follow each other."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows]).combine_chunks()
        keys = list(zip(*(rows.column(c).to_pylist() for c in key), strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        yield from (rows.slice(a, b - a) for a, b in zip(starts, starts[1:], strict=False))
        waiting = rows.slice(starts[-1]) if starts else waiting
    if waiting is not None:
        yield waiting


def refined(aln: DataFrame, key: list[str], rounds: int = ROUNDS, of: Callable = tree_of) -> DataFrame:
    """The alignments (key.., seq_id, seq), each refined by itself, with the number of accepted cuts. A task refines many side by side."""
    kinds = [f.dataType.simpleString() for f in aln.select(*key).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, pa.Table] = {}

        def works() -> Iterator[tuple[int, Generator]]:
            for i, group in enumerate(groups_of(batches, key)):
                own = group.column("seq").to_pylist()
                groups[i] = group.drop(["seq"])
                yield sum(map(len, own)), refining(own, *(of(own) if len(own) > 2 else (None, None)), rounds)

        done = []
        for i, (fresh, accepted) in together(works()):
            done.append(groups.pop(i).append_column("seq", pa.array(fresh, pa.string())).append_column("accepted", pa.array([accepted] * len(fresh), pa.int64())))
            if len(done) == SENT:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    rows = spread(aln.select(*key, "seq_id", "seq"), *key, heavy=True).sortWithinPartitions(*key, "seq_id", "seq")
    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in zip(key, kinds, strict=True)) + ", seq_id long, seq string, accepted long")


def cut_at(aln: DataFrame, anchors: DataFrame, group: str = "set_id") -> DataFrame:
    """group, part, seq_id, seq: the alignments cut before each anchor column (group, col); parts from 0. Without anchors an alignment is one part."""
    edges = anchors.groupBy(group).agg(F.array_sort(F.collect_set("col")).alias("edges"))
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("edges", F.array().cast("array<int>"))))
    cut = aln.join(edges, group, "left").withColumn("starts", starts)
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.length("seq")))
    parts = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda p: F.substr(F.col("seq"), p["a"] + 1, p["b"] - p["a"]))
    return cut.select(group, "seq_id", F.posexplode(parts).alias("part", "seq"))


def joined(parts: DataFrame, group: str = "set_id") -> DataFrame:
    """The parts (group, part, seq_id, seq, accepted) side by side again."""
    own = F.array_sort(F.collect_list(F.struct("part", "seq")))
    return parts.groupBy(group, "seq_id").agg(F.array_join(F.transform(own, lambda p: p["seq"]), "").alias("seq"), F.sum("accepted").alias("accepted"))


def refined_between(aln: DataFrame, anchors: DataFrame, group: str = "set_id", rounds: int = ROUNDS) -> DataFrame:
    """The vertical form: what stands between anchor columns is refined as an alignment of its own, so that one alignment is many tasks."""
    return joined(refined(stash(cut_at(aln, anchors, group), "parts"), [group, "part"], rounds), group)
