"""Guide trees, their weights and roots; and multiple alignment along them."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

from genomill.operators.dp import alone, path_rows


def kmer_distance_matrix(seqs: list[str], k: int = 6) -> np.ndarray:
    own = np.array([max(len(s) - k + 1, 0) for s in seqs])
    text = np.frombuffer("".join(s.ljust(k) for s in seqs).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([max(len(s), k) for s in seqs])
    _, windows = np.unique(text, return_inverse=True)
    size = 1
    while size < k:  # windows are numbered, then pairs of them that make ever longer ones
        more = min(size, k - size)
        _, windows = np.unique(windows[: len(windows) - more] * (windows.max(initial=0) + 1) + windows[more:], return_inverse=True)
        size += more
    counts = np.zeros((len(seqs), windows.max(initial=-1) + 1), np.int64)
    for i, (end, n) in enumerate(zip(ends.tolist(), own.tolist(), strict=True)):
        first = end - max(n + k - 1, k)
        counts[i] = np.bincount(windows[first : first + n], minlength=counts.shape[1])
    d = np.zeros((len(seqs), len(seqs)))
    for a in range(1, len(seqs)):
        shared = np.minimum(counts[a], counts[:a]).sum(axis=1)
        some = np.maximum(own[:a], 1)
        far = np.minimum(3 * (own[a] - shared) / max(own[a], 1), 3 * (own[:a] - shared) / some)
        d[a, :a] = d[:a, a] = np.where((own[:a] > 0) & (own[a] > 0), far, 1.0)
    return d


class Tree:
    """A rooted binary tree: leaves 0 .. n-1, then inner nodes in the order they were joined; the last is the root."""

    def __init__(self, n: int):
        self.n, self.children, self.height = n, [], [0.0] * n
        self.length: dict[int, float] = {}

    @property
    def root(self) -> int:
        return self.n + len(self.children) - 1

    def join(self, a: int, b: int, height: float) -> int:
        self.children.append((a, b))
        self.height.append(height)
        node = self.root
        for x in (a, b):
            self.length[x] = height - self.height[x]
        return node

    def leaves(self, node: int) -> list[int]:
        return [node] if node < self.n else [x for c in self.children[node - self.n] for x in self.leaves(c)]

    def parent(self) -> dict[int, int]:
        return {c: self.n + i for i, pair in enumerate(self.children) for c in pair}

    def newick(self, names: list[str]) -> str:
        def text(x: int) -> str:
            inner = names[x] if x < self.n else "(" + ",".join(text(c) for c in self.children[x - self.n]) + ")"
            return inner + (f":{self.length[x]:.6f}" if x in self.length else "")

        return text(self.root) + ";" if self.n else ";"


def upgma(d: np.ndarray, linkage: str = "biased") -> Tree:
    """Joins the closest pair until one is left; ties go to the lowest indices. Linkages: avg, min, max, biased (0.1 avg + 0.9 min).

    Heights are half the distance of the pair; an average counts both sides alike.
    """
    n = len(d)
    tree, d, names = Tree(n), d.astype(float).copy(), list(range(n))
    np.fill_diagonal(d, np.inf)
    while len(names) > 1:
        a, b = divmod(int(np.where(np.tri(len(d), k=-1, dtype=bool).T, d, np.inf).argmin()), len(d))
        x, y = d[a], d[b]
        merged = {"avg": (x + y) / 2, "min": np.minimum(x, y), "max": np.maximum(x, y), "biased": 0.1 * (x + y) / 2 + 0.9 * np.minimum(x, y)}[linkage]
        node = tree.join(names[a], names[b], d[a, b] / 2)
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d = np.delete(np.delete(d, b, 0), b, 1)
        names[a] = node
        del names[b]
    return tree


def neighbour_joining(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (node, node, length) of the unrooted tree; inner nodes come after the leaves."""
    d, names, edges = d.astype(float).copy(), list(range(len(d))), []
    new = len(d)
    while len(names) > 2:
        r = d.sum(axis=1)
        q = (len(names) - 2) * d - r[:, None] - r[None, :]
        a, b = divmod(int(np.where(np.tri(len(d), k=-1, dtype=bool).T, q, np.inf).argmin()), len(d))
        to_a = d[a, b] / 2 + (r[a] - r[b]) / (2 * (len(names) - 2))
        edges += [(names[a], new, to_a), (names[b], new, d[a, b] - to_a)]
        merged = (d[a] + d[b] - d[a, b]) / 2
        d[a], d[:, a] = merged, merged
        d[a, a] = 0.0
        d = np.delete(np.delete(d, b, 0), b, 1)
        names[a], new = new, new + 1
        del names[b]
    if len(names) == 2:
        edges.append((names[0], names[1], float(d[0, 1])))
    return edges


def midpoint(edges: list[tuple[int, int, float]], leaves: int) -> tuple[int, int, float]:
    """Where the longest path between leaves has its middle: an edge and the distance from its first node."""
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    def far(start: int) -> tuple[float, int, dict[int, tuple[int, float]]]:
        seen, stack = {start: (-1, 0.0)}, [start]
        while stack:
            v = stack.pop()
            for u, w in near.get(v, ()):
                if u not in seen:
                    seen[u] = (v, seen[v][1] + w)
                    stack.append(u)
        end = max((x for x in seen if x < leaves), key=lambda x: (seen[x][1], -x))
        return seen[end][1], end, seen

    total, a, b = max(((far(x)[0], x, far(x)[1]) for x in range(leaves)), key=lambda t: (t[0], -t[1]))
    seen = far(a)[2]
    v = b
    while seen[v][0] >= 0 and seen[seen[v][0]][1] > total / 2:
        v = seen[v][0]
    u = seen[v][0]
    return (u, v, total / 2 - seen[u][1]) if u >= 0 else (v, v, 0.0)


def leaf_weights(tree: Tree) -> np.ndarray:
    """An edge's length is shared by the leaves below it; a leaf's weight is the sum of its shares up to the root."""
    if tree.n < 3:
        return np.full(tree.n, 1 / max(tree.n, 1))
    up, below = tree.parent(), {v: len(tree.leaves(v)) for v in range(tree.root + 1)}
    raw = np.zeros(tree.n)
    for leaf in range(tree.n):
        v = leaf
        while v in up:
            raw[leaf] += tree.length[v] / below[v]
            v = up[v]
    raw[raw < 0.0001] = 1.0
    return raw / raw.sum()


def aligning(seqs: list[str]) -> Generator[tuple, str, list[str]]:
    """`multiple_alignment`; asks for the best path of each merge."""
    at = [i for i, s in enumerate(seqs) if s]
    width = max(map(len, seqs), default=0)
    if len(at) < 2 or width < 2:
        return [s.ljust(width, "-") for s in seqs]
    own = [seqs[i] for i in at]
    tree = upgma(kmer_distance_matrix(own))
    weights = leaf_weights(tree)
    done: dict[int, tuple[list[int], list[str]]] = {i: ([i], [s]) for i, s in enumerate(own)}
    for k, (a, b) in enumerate(tree.children):
        (ia, ra), (ib, rb) = done.pop(a), done.pop(b)
        path = yield (ra, weights[ia]), (rb, weights[ib])
        done[tree.n + k] = (ia + ib, path_rows(path, ra, rb))
    order, rows = done[tree.root]
    aligned = dict(zip(order, rows, strict=True))
    out = ["-" * len(rows[0])] * len(seqs)
    for k, i in enumerate(at):
        out[i] = aligned[k]
    return out


def multiple_alignment(seqs: list[str]) -> list[str]:
    """Progressive alignment along the biased UPGMA tree of k-mer distances, weighted by the tree; one pass.

    Empty sequences become all gaps; if none is longer than one symbol, sequences are padded on the right instead.
    """
    return alone(aligning(seqs))
