"""Histogram boosting of one training set, leaf by leaf, and its scores.

Features are cut into at most 255 bins once. A leaf's histogram of gradient sums is built for the smaller child and taken off the
parent's for the other one; the leaf with the largest gain is split next. Rows are worked off in parts of ``HELD_ROWS``; arrays that are
longer lie in temporary files, so that memory does not grow with the training set.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Sequence

import numpy as np

BINS = 255
HELD_ROWS = 1_000_000
MIN_LEAF = 20
MASK_BITS = 16
LOWEST_BIT = np.array([max((i & -i).bit_length() - 1, 0) for i in range(1 << MASK_BITS)], dtype=np.intp)
NODE = np.dtype([("feature", "<i2"), ("cut", "<f8"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8")])


def array(n: int, kind, held: int = HELD_ROWS) -> np.ndarray:
    """A new array of ``n`` zeros, one of more than ``held`` in a file that goes with it."""
    if n <= held:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=n)


def parts_of(n: int, held: int) -> list[slice]:
    return [slice(i, min(i + held, n)) for i in range(0, n, held)]


def bin_edges(x: np.ndarray, held: int = HELD_ROWS) -> np.ndarray:
    """Upper edges of the bins of a column: between its values, or between quantiles where it has too many."""
    n, v = len(x), np.empty(0)
    line = array(n, np.float64, held)
    for s in parts_of(n, held):
        line[s] = x[s]
    line.sort()  # in place, a file too
    for s in parts_of(n, held):
        v = np.union1d(v, line[s])
        if len(v) > BINS:
            at = np.linspace(0, 1, BINS + 1)[1:-1] * (n - 1)
            low = np.floor(at).astype(np.intp)
            a, b, t = np.asarray(line[low]), np.asarray(line[np.minimum(low + 1, n - 1)]), at - low
            return np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return (v[:-1] + v[1:]) / 2


def binned(columns: Sequence[np.ndarray], fill: Sequence[float], held: int = HELD_ROWS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per column the edges of its bins and the bin of each row; gaps get the column's ``fill``."""
    edges, place = [], []
    for x, m in zip(columns, fill, strict=True):
        full, at = array(len(x), np.float64, held), array(len(x), np.uint8, held)
        for s in parts_of(len(x), held):
            full[s] = np.where(np.isnan(x[s]), m, x[s])
        edges.append(bin_edges(full, held))
        for s in parts_of(len(x), held):
            at[s] = np.searchsorted(edges[-1], full[s])
        place.append(at)
    return edges, place


def best_split(g: np.ndarray, n: np.ndarray, l2: float):
    """(gain, feature, bin) of the best cut of histograms of gradient sums and row counts, both (features, bins); no cut: gain 0."""
    gl, nl = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
    gt, nt = gl[:, -1:], nl[:, -1:]
    gr, nr = gt - gl, nt - nl
    score = lambda g, n: g * g / np.maximum(n + l2, 1e-12)
    gain = score(gl, nl) + score(gr, nr) - score(gt, nt)
    gain[(nl < MIN_LEAF) | (nr < MIN_LEAF)] = 0
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return float(gain[f, b]), f, b


def boost(x: np.ndarray, y: np.ndarray, rate: float, leaves: int, rounds: int, l2: float, held: int = HELD_ROWS) -> bytes:
    """Model as bytes: start value, number of trees, root of each tree, nodes."""
    columns = [x[:, j] for j in range(x.shape[1])]
    return grown(*binned(columns, [np.nan] * len(columns), held), y, rate, leaves, rounds, l2, held)


def grown(edges: Sequence[np.ndarray], place: Sequence[np.ndarray], y: np.ndarray, rate: float, leaves: int, rounds: int, l2: float, held: int = HELD_ROWS) -> bytes:
    """``boost`` of rows that are cut into bins."""
    n, k = len(y), len(place)
    parts = parts_of(n, held)
    start = float(sum(y[s].sum() for s in parts) / n)
    width = max((len(e) for e in edges), default=0) + 1
    counts = np.zeros((k, width), dtype=np.int64)  # of all rows, the same in every round
    for s in parts:
        for j, p in enumerate(place):
            counts[j] += np.bincount(p[s], minlength=width)
    fitted, grad, leaf_of = array(n, np.float64, held), array(n, np.float64, held), array(n, np.min_scalar_type(2 * leaves), held)
    fitted[:] = start
    nodes, roots = [], []

    for _ in range(rounds if k else 0):
        open_: list[tuple] = []  # leaves that can be split: -gain, node, feature, bin, histograms
        first, number_of_leaves = len(nodes), 1

        def leaf(total: float, size: int, hist: tuple) -> int:
            number = len(nodes)
            nodes.append((-1, 0.0, 0, 0, -rate * total / (size + l2)))
            gain, f, b = best_split(*hist, l2)
            if gain > 1e-12:
                heapq.heappush(open_, (-gain, number, f, b, hist))  # noqa: B023
            return number

        total, sums = 0.0, np.zeros((k, width))
        for s in parts:
            grad[s] = fitted[s] - y[s]
            leaf_of[s] = 0
            total += grad[s].sum()
            for j, p in enumerate(place):
                sums[j] += np.bincount(p[s], grad[s], width)
        roots.append(leaf(total, n, (sums, counts)))
        while open_ and number_of_leaves < leaves:
            _, number, f, b, hist = heapq.heappop(open_)
            sizes = [int(hist[1][f, : b + 1].sum()), int(hist[1][f, b + 1 :].sum())]
            small = int(sizes[1] < sizes[0])
            totals, sums, rows = [0.0, 0.0], np.zeros((k, width)), np.zeros((k, width), dtype=np.int64)
            for s in parts:
                some, g = np.flatnonzero(leaf_of[s] == number - first), grad[s]
                low = place[f][s][some] <= b
                for side, own in enumerate((some[low], some[~low])):
                    leaf_of[s][own] = len(nodes) - first + side
                    mine = g[own]
                    totals[side] += mine.sum()
                    if side == small:
                        for j, p in enumerate(place):
                            at = p[s][own]
                            sums[j] += np.bincount(at, mine, width)
                            rows[j] += np.bincount(at, minlength=width)
            hists = [None, None]
            hists[small] = sums, rows
            hists[1 - small] = tuple(a - c for a, c in zip(hist, hists[small], strict=True))
            nodes[number] = (f, edges[f][b], leaf(totals[0], sizes[0], hists[0]), leaf(totals[1], sizes[1], hists[1]), 0.0)
            number_of_leaves += 1
        values = np.array([x[4] for x in nodes[first:]])
        for s in parts:
            fitted[s] += values[leaf_of[s]]
    return np.array([start]).tobytes() + np.array([len(roots), *roots], dtype="<i8").tobytes() + np.array(nodes, dtype=NODE).tobytes()


def boosted_scores(model: bytes, x: np.ndarray) -> np.ndarray:
    """Scores of the rows of ``x``."""
    out = np.full(len(x), np.frombuffer(model, "<f8", 1)[0])
    trees = int(np.frombuffer(model, "<i8", 1, 8)[0])
    nodes = np.frombuffer(model, NODE, offset=16 + 8 * trees)
    feature, cut, left, right, value = (np.ascontiguousarray(nodes[c]) for c in ("feature", "cut", "left", "right", "value"))
    used = np.unique(feature[feature >= 0])
    cuts = {j: np.unique(cut[feature == j]) for j in used}
    bins = {j: np.searchsorted(cuts[j], x[:, j]) for j in used}  # x <= cut number i exactly where the bin is i or less
    every = np.arange(len(x))
    for root in np.frombuffer(model, "<i8", trees, 16):
        ends, splits = leaves_of(int(root), feature, left, right)
        if len(ends) <= MASK_BITS:
            # a bit per leaf, from left to right: a cut passed on its right side clears the leaves on its left, the lowest bit left is the row's leaf
            tables = {}
            for node, first, middle in splits:
                j = feature[node]
                table = tables.setdefault(j, np.full(len(cuts[j]) + 1, (1 << len(ends)) - 1, dtype=np.uint16))
                table[np.searchsorted(cuts[j], cut[node]) + 1 :] &= np.uint16(~((1 << middle) - (1 << first)) & 0xFFFF)
            mask = np.full(len(x), 1, dtype=np.uint16) if not tables else None
            for j, table in tables.items():
                mask = table[bins[j]] if mask is None else mask & table[bins[j]]
            out += value[ends][LOWEST_BIT[mask]]
            continue
        at = np.full(len(x), root)
        while len(some := every[feature[at] >= 0]):
            node = at[some]
            at[some] = np.where(x[some, feature[node]] <= cut[node], left[node], right[node])
        out += value[at]
    return out


def leaves_of(root: int, feature: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Leaves of a tree from left to right, and its splits as (node, number of the first leaf below it, of the first one right of its cut)."""
    ends: list[int] = []
    splits: list[tuple[int, int, int]] = []

    def visit(node: int) -> None:
        if feature[node] < 0:
            ends.append(node)
            return
        first = len(ends)
        visit(left[node])
        splits.append((node, first, len(ends)))
        visit(right[node])

    visit(root)
    return ends, splits
