"""What each feature adds to a tree model's output, exactly.

A leaf counts for a row by the product, over the features on its path, of 1 or 0
(whether the row's value leads there), or of the share of training weight that does,
for features that are not known.  A feature's Shapley value is the mean of what
knowing it adds over all orders, and that is an integral: of all other features' factors, each
mixed from known and unknown in the share t, for t from 0 to 1.  The integrand is a polynomial, so a few
Gauss-Legendre points give it without error, for all rows of a batch at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.boosting import Boosted, Tree
from tidemark.sources.tables import shared_folder

#: Rows for which factors are held at a time.
ROWS_AT_ONCE = 256


class Leaf:
    """Value, and by feature on the path the interval (low, high] that leads here and the share of weight that goes there."""

    def __init__(self, value: float, path: dict[int, tuple[float, float, float]]) -> None:
        self.value, self.features = value, np.array(list(path), int)
        self.low, self.high, self.share = (np.array([x[k] for x in path.values()], float) for k in range(3))
        points, weights = np.polynomial.legendre.leggauss(max(1, (len(path) + 1) // 2))
        self.points, self.weights = (points + 1) / 2, weights / 2

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        own = x[:, self.features]
        known = ((own > self.low) & (own <= self.high)).astype(float)
        mixed = known[:, :, None] * self.points + (self.share[:, None] * (1 - self.points))
        before, after = np.ones_like(mixed), np.ones_like(mixed)
        before[:, 1:] = np.cumprod(mixed, axis=1)[:, :-1]
        after[:, :-1] = np.cumprod(mixed[:, ::-1], axis=1)[:, ::-1][:, 1:]
        out[:, self.features] += self.value * (known - self.share) * ((before * after) @ self.weights)


def leaves(tree: Tree) -> Iterator[Leaf]:
    waiting: list[tuple[int, dict]] = [(0, {})]
    while waiting:
        node, path = waiting.pop()
        f = tree.feature[node]
        if f < 0:
            yield Leaf(tree.value[node], path)
            continue
        for side, child in enumerate(tree.children[node]):
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            part = tree.cover[child] / tree.cover[node]
            inside = (low, min(high, tree.cut[node])) if side == 0 else (max(low, tree.cut[node]), high)
            waiting.append((child, path | {f: (*inside, share * part)}))


def expectation(tree: Tree) -> float:
    """The mean output over the training weight."""
    ends = [k for k, f in enumerate(tree.feature) if f < 0]
    return sum(tree.value[k] * tree.cover[k] for k in ends) / tree.cover[0]


def spark_trees(model) -> list[Tree]:
    """The trees of a fitted Spark ML tree classifier as they add up: to the probability of class 1, or for boosted trees to the log odds."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    boosted = "GBT" in type(model).__name__
    if "nodeData" in rows.columns:
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = rows.withColumn("tree", F.lit(0))
    nodes = rows.select("tree", "id", "prediction", "impurityStats", "leftChild", "rightChild", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), F.col("split.numCategories").alias("kinds")).orderBy("tree", "id").collect()
    if any(n.leftChild >= 0 and n.kinds >= 0 for n in nodes):
        raise ValueError("trees that split categories aren't explained")
    number = 1 + max(n.tree for n in nodes)
    weights = [2.0 * w for w in model.treeWeights] if boosted else [1 / number] * number
    out = [Tree() for _ in range(number)]
    for n in nodes:
        stats = n.impurityStats
        value = n.prediction if boosted else stats[1] / max(sum(stats), 1e-300)
        out[n.tree].node(weights[n.tree] * value, stats[0] if boosted else sum(stats))
        if n.leftChild >= 0:
            out[n.tree].split(n.id, n.feature, n.cut, (n.leftChild, n.rightChild))
    return out


def trees_of(fitted) -> list[Tree]:
    return fitted.trees if isinstance(fitted, Boosted) else spark_trees(fitted)


def base_value(fitted) -> float:
    """What all contributions of a row are added to."""
    return getattr(fitted, "base", 0.0) + sum(map(expectation, trees_of(fitted)))


def tree_contributions(fitted, df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """key, feature and value: one row for each feature of each row."""
    every = [leaf for tree in trees_of(fitted) for leaf in leaves(tree) if len(leaf.features)]
    shipped = df.sparkSession.sparkContext.broadcast([(x.value, x.features, x.low, x.high, x.share) for x in every])  # as large as the model
    names = list(features)

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends = [Leaf(value, dict(zip(fs.tolist(), zip(low, high, share, strict=True), strict=True))) for value, fs, low, high, share in shipped.value]
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start : start + ROWS_AT_ONCE]
                x = part[names].to_numpy(float)
                out = np.zeros(x.shape)
                for leaf in ends:
                    leaf.add(x, out)
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), len(names)), "feature": names * len(part), "value": out.ravel()})

    return df.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in names)).mapInPandas(explained, f"`{key}` {df.schema[key].dataType.simpleString()}, feature string, value double")
