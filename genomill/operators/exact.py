"""Maximal unique matches of a few sequences: windows that occur once are extended, what repeated windows cover is sorted.

A match that holds a window occurring once in every sequence is the extension of that window. The others consist of
repeated windows only; their symbols, a part of the text, are put into suffix order. Common prefixes are compared only
where the symbol before differs, elsewhere they are one less than at the place before. Both parts take some 40 bytes a symbol
and time that follows the text, not the length of the matches.
"""

from __future__ import annotations

import numpy as np

_CODES = np.full(256, 4, np.int8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Symbols of a window at most: two bits each. Symbols of regions that are searched in one.
WIDEST, BESIDE = 31, 1 << 19


def codes_of(seq: str | bytes | np.ndarray) -> np.ndarray:
    """0 to 3 for A, C, G, T; 4 for all else, which matches nothing. An array has bytes."""
    return _CODES[seq if isinstance(seq, np.ndarray) else np.frombuffer(seq if isinstance(seq, bytes) else seq.encode(), np.uint8)]


class Windows:
    """The places of all windows of k symbols, by the windows' values.

    part: of several texts in one, each with a symbol of no letter behind it, the text's number at each place; windows of two texts are never equal.
    """

    def __init__(self, codes: np.ndarray, k: int, part: np.ndarray | None = None):
        self.codes, self.k, self.part = codes, min(k, WIDEST), part
        n = max(len(codes) - self.k + 1, 0)
        value, odd = np.zeros(n, np.int64), np.concatenate(([0], np.cumsum(codes > 3)))
        for i in range(self.k if n else 0):
            value = value << 2 | codes[i : i + n] & 3
        if part is not None:
            value |= part[:n] << 2 * self.k
        at = np.flatnonzero(odd[self.k :][:n] == odd[:n]) if n else np.zeros(0, np.int64)
        order = np.argsort(value[at], kind="stable")
        self.places, ordered = at[order], value[at][order]
        self.first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        self.values, self.count = ordered[self.first], np.diff(np.append(self.first, len(ordered)))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where there is no such window."""
        at = np.searchsorted(self.values, values)
        at[at == len(self.values)] = -1
        return np.where((at >= 0) & (self.values[at] == values), at, -1) if len(self.values) else np.full(len(values), -1)

    def places_of(self, index: np.ndarray) -> np.ndarray:
        """All places of the windows of these indices, in order."""
        count = self.count[index]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.sort(self.places[np.repeat(self.first[index], count) + step])


def unique_matches(seqs: list[str], least: int) -> list[tuple[tuple[int, ...], int]]:
    """(starts, length) of the maximal matches of at least `least` symbols that occur once in each sequence, by first start.

    N and ends match nothing; a sequence alone has no matches.
    """
    return matches_of([Windows(codes_of(s), least) for s in seqs], least) if len(seqs) > 1 else []


def matches_of(windows: list[Windows], least: int) -> list[tuple[tuple[int, ...], int]]:
    """The same from the windows of each sequence."""
    return [(tuple(r[:-1]), r[-1]) for r in match_rows(windows, least).tolist()]


def match_rows(windows: list[Windows], least: int) -> np.ndarray:
    """The same as rows of starts and a length. Where windows have parts, matches are those of each part by itself."""
    base = min(windows, key=lambda w: len(w.values))
    index = np.stack([np.arange(len(base.values)) if w is base else w.find(base.values) for w in windows])
    index = index[:, (index >= 0).all(axis=0)]
    once = np.stack([w.count[i] == 1 for w, i in zip(windows, index, strict=True)]).all(axis=0)
    codes = [w.codes for w in windows]
    found = [_extended(codes, np.stack([w.places[w.first[i[once]]] for w, i in zip(windows, index, strict=True)]), base.k)]
    if not once.all():
        found.append(_sorted_out(codes, [w.places_of(i[~once]) for w, i in zip(windows, index, strict=True)], base.k, [w.part for w in windows]))
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[rows[:, -1] >= least]


def regions_beside(of: np.ndarray, k: int) -> list[np.ndarray]:
    """Regions (places in `of`, which has their sizes in symbols) in lots of some `BESIDE` symbols that can be searched as parts of one text: part and window fit a number."""
    most = 1 << min(62 - 2 * min(k, WIDEST), 40)
    lot = np.cumsum(of) // BESIDE if most > 1 else np.arange(len(of))
    edges = np.flatnonzero(np.diff(lot, prepend=-1))
    return [np.arange(a, b)[i : i + most] for a, b in zip(edges, [*edges[1:], len(of)], strict=True) for i in range(0, b - a, most)]


def matches_beside(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, starts, lengths) of the matches of many regions, each searched by itself, in order of region and starts.

    data: codes; starts, sizes: where each region's part of every sequence lies there (regions x sequences).
    """
    windows, first = [], []
    for at, size in zip(starts.T, sizes.T, strict=True):
        wide = size + 1  # with a break behind
        begin = np.cumsum(wide) - wide
        part = np.repeat(np.arange(len(size)), wide)
        place = np.arange(wide.sum()) - begin[part]
        codes = np.where(place < size[part], data[np.minimum(at[part] + place, len(data) - 1)], 4).astype(np.int8) if len(data) else np.full(len(part), 4, np.int8)
        windows.append(Windows(codes, least, part if len(size) > 1 else None))
        first.append(begin)
    rows = match_rows(windows, least)
    region = np.searchsorted(first[0], rows[:, 0], "right") - 1
    return region, rows[:, :-1] - np.stack(first, axis=1)[region], rows[:, -1]


def _alike(codes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Whether all sequences have the same A, C, G or T at their places (rows of `at`); places beyond the ends have none."""
    inside = np.logical_and.reduce([(p >= 0) & (p < len(c)) for c, p in zip(codes, at, strict=True)])
    seen = [c[np.where(inside, p, 0)] if len(c) else np.full(len(p), 4) for c, p in zip(codes, at, strict=True)]
    return inside & (seen[0] < 4) & np.logical_and.reduce([s == seen[0] for s in seen])


def _extended(codes: list[np.ndarray], places: np.ndarray, k: int) -> np.ndarray:
    """Windows that occur once, joined along their diagonals and extended to both sides while all sequences agree."""
    places = places[:, np.argsort(places[0])]
    if not places.shape[1]:
        return np.zeros((0, len(codes) + 1), np.int64)
    heads = np.flatnonzero(np.append(True, (np.diff(places, axis=1) != 1).any(axis=0)))
    starts, length = places[:, heads].astype(np.int64), np.diff(np.append(heads, places.shape[1])) - 1 + k
    for step in (-1, 1):
        open_ = np.arange(len(length))
        while len(open_):
            open_ = open_[_alike(codes, starts[:, open_] + (-1 if step < 0 else length[open_]))]
            length[open_] += 1
            if step < 0:
                starts[:, open_] -= 1
    return np.concatenate((starts, length[None])).T


def _sorted_out(codes: list[np.ndarray], at: list[np.ndarray], k: int, parts: list[np.ndarray | None]) -> np.ndarray:
    """Unique maximal matches among what the windows at the given places cover, without those that go on outside of it."""
    n, symbols, places, owners, own_parts = len(codes), [], [], [], []
    for i, (c, own) in enumerate(zip(codes, at, strict=True)):
        cut = np.flatnonzero(np.diff(own) > k)
        first, last = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)] + k
        size = last - first + 1  # with a break behind each stretch
        place = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text = c[np.minimum(place, len(c) - 1)]
        text[np.cumsum(size) - 1] = -1
        symbols.append(text)
        places.append(place)
        owners.append(np.full(len(place), i, np.int32))
        own_parts.append(np.zeros(0, np.int64) if parts[i] is None else parts[i][np.minimum(place, len(c) - 1)])
    text, place, owner = np.concatenate(symbols), np.concatenate(places), np.concatenate(owners)
    order, common = suffix_order(text, None if parts[0] is None else np.concatenate(own_parts))
    if len(order) < n:
        return np.zeros((0, n + 1), np.int64)
    edge = np.concatenate(([0], common, [0]))  # edge[i]: between order[i - 1] and order[i]
    shared = np.lib.stride_tricks.sliding_window_view(common, n - 1).min(axis=1)
    good = np.flatnonzero((shared >= k) & (edge[: len(shared)] < shared) & (edge[n : n + len(shared)] < shared))
    who = np.sort(order[good[:, None] + np.arange(n)], axis=1)
    mine = (owner[who] == np.arange(n)).all(axis=1)
    starts, length = place[who[mine]].T, shared[good[mine]]
    ends = _alike(codes, starts - 1) | _alike(codes, starts + length)
    return np.concatenate((starts, length[None])).T[~ends]


def suffix_order(text: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order and the common prefixes of neighbours. Symbols 0 to 3; each -1 is a break like no other.

    part: a number for each place; suffixes are in order part by part, and those of two parts have no prefix in common.
    """
    n = len(text)
    breaks = np.flatnonzero(text < 0)
    left = (breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n)).astype(np.int32)  # symbols before the next break; the last symbol is one
    packed = np.zeros(n, np.int64)
    for i in range(WIDEST):  # the next symbols, 0 behind a break
        packed = packed << 2 | np.where(left > i, np.append(text[i:], np.zeros(min(i, n), text.dtype)), 0)
    size = np.minimum(left, WIDEST)
    tie = np.where(left < WIDEST, np.arange(n), 0)
    order = np.lexsort((tie, size, packed) if part is None else (tie, size, packed, part))
    together = np.ones(max(n - 1, 0), bool) if part is None else np.diff(part[order]) == 0
    same = together & (np.diff(packed[order]) == 0) & (size[order[1:]] == WIDEST) & (size[order[:-1]] == WIDEST)
    rank, slot, step = np.empty(n, np.int64), np.arange(n), WIDEST
    while True:  # suffixes alike in `step` symbols have the rank of the first of them
        head = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(slot)), 0))
        rank[order[slot]] = slot[head]
        tied = np.append(False, same) | np.append(same, False)
        slot = slot[tied]
        if not len(slot):
            break
        own = order[slot]
        own = own[np.lexsort((rank[own + step], rank[own]))]
        order[slot] = own
        same = (np.diff(rank[own]) == 0) & (np.diff(rank[own + step]) == 0)
        step *= 2
    before = np.full(n, -1)
    before[order[1:]] = order[:-1] if part is None else np.where(np.diff(part[order]) == 0, order[:-1], -1)
    common, place = np.zeros(n, np.int64), np.arange(n)
    fresh = before >= 0
    fresh[1:] &= ~((before[1:] > 0) & (text[:-1] == text[before[1:] - 1]) & (text[:-1] >= 0))
    open_, done = np.flatnonzero(fresh), 0
    while len(open_):
        a, b = open_ + done, before[open_] + done
        other, c = packed[a] ^ packed[b], np.zeros(len(a), np.int64)
        for s in (16, 8, 4, 2, 1):
            c += s * (other >> 2 * (WIDEST - c - s) == 0)
        c = np.minimum(c, np.minimum(left[a], left[b]))
        common[open_] += c
        open_, done = open_[c == WIDEST], done + WIDEST
    last = np.maximum.accumulate(np.where(fresh | (before < 0), place, 0))
    common = common[last] - (place - last)
    return order, common[order[1:]]
