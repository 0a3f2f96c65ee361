"""A partition of points into cells, with bounds for distances that skip missing coordinates.

A distance is taken over the coordinates that both points have, and scaled up to
all.  Cells are the leaves of a tree whose nodes cut a coordinate in two, and put
points that miss it apart.  Of a cell its box, and which coordinates all of its
points have and which some, give the least distance that any of them can have.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def distances(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Euclidean distances over the coordinates that both have, scaled up to all; infinite if there are none."""
    out = np.empty((len(rows), len(known)))
    for k, row in enumerate(rows):
        gaps = known - row
        shared = ~np.isnan(gaps)
        n = shared.sum(axis=1)
        total = np.where(shared, gaps, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = np.where(n > 0, np.sqrt((total * total).sum(axis=1) * gaps.shape[1] / n), np.inf)
    return out


@dataclass
class Tree:
    """By node the coordinate that it cuts (-1 for a leaf), where, and its children: below, from there on, and missing; of a leaf, `cell` is its number."""

    axis: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    children: list[tuple[int, int, int]] = field(default_factory=list)
    cell: list[int] = field(default_factory=list)
    cells: int = 0

    def node(self) -> int:
        self.axis.append(-1)
        self.cut.append(0.0)
        self.children.append((0, 0, 0))
        self.cell.append(-1)
        return len(self.axis) - 1

    def cells_of(self, points: np.ndarray) -> np.ndarray:
        axis, cut, children = np.array(self.axis), np.array(self.cut), np.array(self.children)
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(rows := rows[axis[at[rows]] >= 0]):
            node = at[rows]
            value = points[rows, axis[node]]
            at[rows] = children[node, np.where(np.isnan(value), 2, value >= cut[node])]
        return np.array(self.cell)[at]


def grown(points: np.ndarray, leaf: int) -> Tree:
    """A tree whose leaves have `leaf` of these points at most, as far as they can be told apart; each node cuts the coordinate that varies most, at its median."""
    tree = Tree()
    waiting = [(tree.node(), np.arange(len(points)))]
    while waiting:
        node, rows = waiting.pop()
        own = points[rows]
        present = ~np.isnan(own)
        counts = present.sum(axis=0)
        centre = np.divide(np.where(present, own, 0.0).sum(axis=0), counts, out=np.zeros(own.shape[1]), where=counts > 0)
        varies = np.where(present, own - centre, 0.0) ** 2
        order = np.argsort(-varies.sum(axis=0), kind="stable") if len(rows) > leaf else []
        for axis in order:
            values = np.sort(own[present[:, axis], axis])
            if not len(values) or not values[-1] > values[0]:
                continue
            middle = values[len(values) // 2]
            cut = middle if middle > values[0] else values[np.searchsorted(values, middle, side="right")]
            sides = np.where(present[:, axis], own[:, axis] >= cut, 2)
            tree.axis[node], tree.cut[node] = int(axis), float(cut)
            tree.children[node] = tuple(tree.node() for _ in range(3))
            waiting += [(child, rows[sides == side]) for side, child in enumerate(tree.children[node])]
            break
        else:
            tree.cell[node], tree.cells = tree.cells, tree.cells + 1
    return tree


def least_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, count: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """By cell a bound below the distance from `point` to any of its points; infinite if none shares a coordinate with it.

    known: how many of a cell's `count` points have each coordinate; low and high are their box;
    missing: how many coordinates a point of it misses at most.  Coordinates that all have
    are part of every distance; of the others those are taken that make the mean of
    squares least, all but `missing` of them at least.
    """
    own = ~np.isnan(point)
    with np.errstate(invalid="ignore"):
        gap = np.maximum(0.0, np.maximum(low - point, point - high)) ** 2
    always, ever = own & (known == count[:, None]) & (known > 0), own & (known > 0)
    sure = np.where(always, gap, 0.0).sum(axis=1)[:, None]
    others = np.sort(np.where(ever & ~always, gap, np.inf), axis=1)
    sums = sure + np.concatenate((np.zeros((len(low), 1)), np.cumsum(others, axis=1)), axis=1)
    numbers = always.sum(axis=1)[:, None] + np.arange(others.shape[1] + 1)
    taken = np.arange(others.shape[1] + 1)
    least = (ever & ~always).sum(axis=1) - missing
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.where((numbers > 0) & (taken >= least[:, None]), sums / numbers, np.inf)
    return np.sqrt(means.min(axis=1) * len(point))


def greatest_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray) -> np.ndarray:
    """By cell the distance to the farthest corner of its box, over the coordinates that it and `point` have; infinite if there are none."""
    shared = ~np.isnan(point) & (known > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        gap = np.where(shared, np.maximum(np.abs(low - point), np.abs(high - point)), 0.0) ** 2
        return np.sqrt(np.where(shared.any(axis=1), gap.sum(axis=1) * len(point) / shared.sum(axis=1), np.inf))
