"""Boosted trees that grow leaf by leaf on histograms.

Values are told apart by up to 255 cuts for each feature.  A job sums, for each
node asked and each feature, the slopes and curvatures of the loss by bin; from
these sums the driver takes splits.  The leaf of the greatest gain is split first,
until the tree has `leaves` of them, however deep it gets.  A job gives the sums of
the children of all leaves that may be split, so several splits are taken between
two jobs.  After each tree the rows' margins are written anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.blocks import PACKED, Block, packed, summed
from tidemark.sources.tables import cut_lineage

BINS = 256


@dataclass
class Tree:
    """Nodes: the feature that a node cuts (-1 for a leaf) and where, its two children (up to the cut, beyond it), its value and its cover."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def node(self, value: float, cover: float) -> int:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.children.append((-1, -1))
        self.value.append(value)
        self.cover.append(cover)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, children: tuple[int, int]) -> None:
        self.feature[node], self.cut[node], self.children[node] = feature, cut, children

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        feature, cut, children = np.array(self.feature), np.array(self.cut), np.array(self.children)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            at[rows] = children[node, (x[rows, feature[node]] > cut[node]).astype(int)]
        return at

    def values_of(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(x)]

    def depth(self) -> int:
        depths = [0] * len(self.feature)
        for node, pair in enumerate(self.children):
            for child in pair if self.feature[node] >= 0 else ():
                depths[child] = depths[node] + 1
        return max(depths)

    def leaf_count(self) -> int:
        return sum(f < 0 for f in self.feature)


@dataclass
class Boosted:
    rounds: int = 50
    leaves: int = 31
    depth: int = -1
    rate: float = 0.1
    least_rows: int = 20
    least_curvature: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 1
    features: list[str] = field(default_factory=list)
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def cuts(self, train: DataFrame) -> list[np.ndarray]:
        found = train.approxQuantile(self.features, [k / (BINS - 1) for k in range(1, BINS - 1)], 1 / (4 * BINS))
        return [np.unique(np.array(x, float)) for x in found]

    def fit(self, train: DataFrame, features: Sequence[str], label: str) -> Boosted:
        self.features, self.trees = list(features), []
        counts = train.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
        positives = counts[1] or 0.0
        ratio = (counts[0] - positives) / positives if positives else 1.0
        cuts = self.cuts(train.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in features)))
        self.base = 0.0  # both classes have the same weight
        blocks = packed(train, features, label, F.when(F.col(label) == 1, ratio).otherwise(1.0)).cache()
        for _ in range(self.rounds):
            tree = self.grown(blocks, cuts)
            if tree.leaf_count() == 1:
                break
            self.trees.append(tree)
            moved = cut_lineage(blocks.mapInArrow(lambda parts, tree=tree: raised(parts, tree), PACKED)).cache()
            blocks.unpersist()
            blocks = moved
        blocks.unpersist()
        return self

    def histograms(self, blocks: DataFrame, tree: Tree, asked: list[int], cuts: list[np.ndarray]) -> np.ndarray:
        """By node asked, feature and bin: slope, curvature and rows."""
        place = {node: k for k, node in enumerate(asked)}
        shape = (3, len(asked), len(cuts), BINS)

        def counted(block: Block) -> np.ndarray:
            at = np.array([place.get(k, -1) for k in range(len(tree.feature))])[tree.leaves_of(block.x)]
            here = at >= 0
            x, at = block.x[here], at[here]
            p = 1 / (1 + np.exp(-block.margin[here]))
            w = block.w[here]
            slope, curvature = w * (p - block.y[here]), w * p * (1 - p)
            out = np.zeros((3, len(asked) * len(cuts) * BINS))
            for f, cut in enumerate(cuts):
                spot = (at * len(cuts) + f) * BINS + np.searchsorted(cut, x[:, f], side="left")
                for k, values in enumerate((slope, curvature, None)):
                    out[k] += np.bincount(spot, values, out.shape[1])
            return out.ravel()

        return summed(blocks, counted, int(np.prod(shape))).reshape(shape)

    def weight(self, slope: np.ndarray | float, curvature: np.ndarray | float) -> np.ndarray:
        """The value that a leaf of these sums gets."""
        return -np.sign(slope) * np.maximum(np.abs(slope) - self.l1, 0.0) / np.maximum(np.asarray(curvature) + self.l2, 1e-12)

    def worth(self, slope: np.ndarray, curvature: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(slope) - self.l1, 0.0) ** 2 / np.maximum(curvature + self.l2, 1e-12)

    def best_split(self, sums: np.ndarray, cuts: list[np.ndarray]) -> tuple | None:
        """Gain, feature, cut, and the sums (slope, curvature, rows) of both sides; None if nothing is gained."""
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        whole = sums.sum(axis=2)[:, :, None]
        right = whole - left
        allowed = (np.minimum(left[2], right[2]) >= self.least_rows) & (np.minimum(left[1], right[1]) >= self.least_curvature)
        gain = np.where(allowed, self.worth(left[0], left[1]) + self.worth(right[0], right[1]) - self.worth(whole[0], whole[1]), -np.inf)
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, b] > 1e-10:
            return None
        return float(gain[f, b]), int(f), float(cuts[f][b]), left[:, f, b], right[:, f, b]

    def grown(self, blocks: DataFrame, cuts: list[np.ndarray]) -> Tree:
        tree = Tree()
        root = tree.node(0.0, 0.0)
        sums = self.histograms(blocks, tree, [root], cuts)[:, 0]
        totals = sums[:, 0].sum(axis=1)
        tree.value[root], tree.cover[root] = self.rate * float(self.weight(totals[0], totals[1])), float(totals[1])
        open_: dict[int, tuple] = {}  # leaves with their best split
        depths, children = {root: 0}, {}  # children: of leaves that may be split, the best splits of their two sides
        if split := self.best_split(sums, cuts):
            open_[root] = split
        while open_ and tree.leaf_count() < self.leaves:
            node = max(open_, key=lambda k: (open_[k][0], -k))
            if node not in children:
                children |= self.looked_ahead(blocks, tree, {k: s for k, s in open_.items() if k not in children}, cuts, depths)
            _, f, cut, *sides = open_.pop(node)
            pair = tuple(tree.node(self.rate * float(self.weight(s[0], s[1])), float(s[1])) for s in sides)
            tree.split(node, f, cut, pair)
            for child, split in zip(pair, children.pop(node), strict=True):
                depths[child] = depths[node] + 1
                if split:
                    open_[child] = split
        return tree

    def looked_ahead(self, blocks: DataFrame, tree: Tree, splits: dict[int, tuple], cuts: list[np.ndarray], depths: dict[int, int]) -> dict[int, list]:
        """The best splits of the children that these leaves would have."""
        deeper = {k: s for k, s in splits.items() if self.depth < 0 or depths[k] + 1 < self.depth}
        out = {k: [None, None] for k in splits}
        if not deeper:
            return out
        trial = Tree(*([*x] for x in (tree.feature, tree.cut, tree.children, tree.value, tree.cover)))
        asked = []
        for node, (_, f, cut, *_) in deeper.items():
            pair = trial.node(0.0, 0.0), trial.node(0.0, 0.0)
            trial.split(node, f, cut, pair)
            asked += pair
        sums = self.histograms(blocks, trial, asked, cuts)
        for k, node in enumerate(deeper):
            out[node] = [self.best_split(sums[:, 2 * k + side], cuts) for side in (0, 1)]
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.values_of(x) for t in self.trees), np.zeros(len(x)))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        margins, width = self.margins, len(self.features)

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, width))
            return pd.Series(1 / (1 + np.exp(-margins(x))))

        return df.withColumn(name, probability(F.array(*(F.col(f"`{c}`").cast("double") for c in self.features))))


def raised(parts: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Blocks whose margins have risen by what the tree gives."""
    for part in parts:
        margins = [(b.margin + tree.values_of(b.x)).tobytes() for b in map(Block, part.to_pylist())]
        place = part.schema.get_field_index("margin")
        yield part.set_column(place, part.schema.field(place), pa.array(margins, pa.binary()))
