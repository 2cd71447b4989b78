"""Block alignment and extension for small sets of sequences."""

from __future__ import annotations

from collections.abc import Generator

from genomill.operators.dp import alone
from genomill.operators.maximal import collinear, recursive_anchors
from genomill.operators.trees import aligning, multiple_alignment


def filling(parts: list[str]) -> Generator[tuple, str, list[str]]:
    """`align_gap`; asks for the best path of each merge."""
    if any(not p for p in parts) or max(map(len, parts)) <= 1:
        width = max(map(len, parts), default=0)
        return [p.ljust(width, "-") for p in parts]
    return (yield from aligning(parts))


def align_gap(parts: list[str]) -> list[str]:
    """The stretch between two anchors: padded on the right if a part is empty or all are at most one base, else aligned."""
    return alone(filling(parts))


def block_alignment(seqs: list[str], factor: float = 0.6) -> list[str]:
    """The heaviest collinear anchors as they are, in lower case; what lies between them aligned, in upper case."""
    at, rows = [0] * len(seqs), [""] * len(seqs)
    for starts, length, _ in [*collinear(recursive_anchors(seqs, factor)), (tuple(map(len, seqs)), 0, 0)]:
        gap = align_gap([s[a:b] for s, a, b in zip(seqs, at, starts, strict=True)])
        rows = [r + g.upper() + s[b : b + length].lower() for r, g, s, b in zip(rows, gap, seqs, starts, strict=True)]
        at = [b + length for b in starts]
    return rows


def stop_at_indels(rows: list[str], run: int = 10, share: float = 0.5, least: int = 10) -> list[str]:
    """Cut one column before the first `run` columns in a row with more than `share` gaps; less than `least` columns are dropped."""
    count = 0
    for i, column in enumerate(zip(*rows, strict=True)):
        count = count + 1 if column.count("-") > share * len(rows) else 0
        if count == run:
            cut = max(i - run, 0)
            return [r[:cut] if cut >= least else "" for r in rows]
    return rows


def extend_block(tails: list[str], first: int = 10) -> list[str]:
    """Aligns ever longer windows (first, 2 * first, ...) of what follows a block, until indels stop it or the tails end."""
    size, done = first, [""] * len(tails)
    longest = max(map(len, tails), default=0)
    while True:
        rows = multiple_alignment([t[:size] for t in tails])
        cut = stop_at_indels(rows)
        if len(cut[0]) < len(rows[0]):
            return cut if len(cut[0]) > len(done[0]) else done
        done = rows
        if size >= longest:
            return done
        size *= 2
