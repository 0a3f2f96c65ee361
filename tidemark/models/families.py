"""Classifiers by family: fit on a frame of features, score another, explain single rows.

Features are columns of numbers; `weight` balances the classes.  The kernel machine
is a linear one on random Fourier features of a radial kernel, with its margins
calibrated; boosted trees and the network are this package's own.  A pretrained
transformer isn't offered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification as ml
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.boosting import Boosted
from tidemark.models.network import Network

LABEL, WEIGHT, VECTOR = "target", "_weight", "_features"


def balanced(df: DataFrame, label: str = LABEL) -> Column:
    """The weight by which both classes count the same."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    n, positives = row[0], row[1] or 0.0
    return F.when(F.col(label) == 1, n / (2 * max(1.0, positives))).otherwise(n / (2 * max(1.0, n - positives)))


def forest(trees: int = 200, depth: int = 15, seed: int = 1) -> ml.RandomForestClassifier:
    return ml.RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="log2", weightCol=WEIGHT, seed=seed)


def boosted(rounds: int = 50, leaves: int = 31, depth: int = -1, rate: float = 0.1, least_rows: int = 20, l1: float = 0.0, l2: float = 0.0, seed: int = 1) -> Boosted:
    return Boosted(rounds, leaves, depth, rate, least_rows, l1=l1, l2=l2, seed=seed)


def tree(depth: int = 5, seed: int = 1) -> ml.DecisionTreeClassifier:
    return ml.DecisionTreeClassifier(impurity="entropy", maxDepth=depth, weightCol=WEIGHT, seed=seed)


def logistic(penalty: float = 0.01, seed: int = 1) -> ml.LogisticRegression:
    return ml.LogisticRegression(regParam=penalty, elasticNetParam=0.0, weightCol=WEIGHT)


def kernel(penalty: float = 0.001, waves: int = 256, gamma: float | None = None, seed: int = 1) -> Kernel:
    return Kernel(penalty, waves, gamma, seed)


@dataclass
class Kernel:
    """A linear machine on cosine waves whose inner products come near a radial kernel's exp(-gamma * distance squared).

    Without gamma, it is 1 / (features * variance of all values).
    """

    penalty: float
    waves: int
    gamma: float | None
    seed: int
    directions: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def drawn(self, rows: DataFrame, features: Sequence[str]) -> None:
        gamma = self.gamma
        if gamma is None:
            values = F.explode(F.array(*(F.col(f"`{c}`").cast("double") for c in features))).alias("v")
            variance = rows.select(values).agg(F.var_pop("v")).first()[0] or 1.0
            gamma = 1 / (len(features) * variance)
        rng = np.random.default_rng(self.seed)
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (len(features), self.waves))
        self.offsets = rng.uniform(0, 2 * np.pi, self.waves)

    def mapped(self, rows: DataFrame, features: Sequence[str]) -> DataFrame:
        directions, offsets = self.directions, self.offsets

        @F.pandas_udf("array<double>")
        def waved(points: pd.Series) -> pd.Series:
            x = np.stack(points.to_list()) if len(points) else np.zeros((0, len(directions)))
            return pd.Series(list(np.sqrt(2 / len(offsets)) * np.cos(x @ directions + offsets)))

        return rows.withColumn(VECTOR, array_to_vector(waved(F.array(*(F.col(f"`{c}`").cast("double") for c in features)))))

    def estimator(self) -> ml.LinearSVC:
        return ml.LinearSVC(regParam=self.penalty, weightCol=WEIGHT)


def network(hidden: Sequence[int] = (512, 256, 128), rounds: int = 100, rate: float = 1e-3, dropout: float = 0.3, decay: float = 1e-2, batch_rows: int = 4096, patience: int = 10, seed: int = 1) -> Network:
    return Network(tuple(hidden), rate, dropout, decay, batch_rows, rounds, patience, seed=seed)


FAMILIES: dict[str, Callable] = {"rf": forest, "lgb": boosted, "dt": tree, "lr": logistic, "svm": kernel, "mlp": network}
#: Those that compare or sum features, so that scaling makes a difference to them.
SCALED = ("lr", "svm", "mlp")


def build(family: str, parameters: Mapping | None = None, seed: int = 1) -> Family:
    if family not in FAMILIES:
        raise ValueError(f"unknown model family {family!r}; there are {', '.join(FAMILIES)}")
    return Family(family, dict(parameters or {}), seed)


@dataclass
class Family:
    name: str
    parameters: dict = field(default_factory=dict)
    seed: int = 1
    features: list[str] = field(default_factory=list)
    fitted: object = None
    calibration: object = None
    waves: Kernel | None = None

    def vectors(self, df: DataFrame) -> DataFrame:
        if self.waves:
            return self.waves.mapped(df, self.features)
        return VectorAssembler(inputCols=self.features, outputCol=VECTOR, handleInvalid="error").transform(df)

    def fit(self, train: DataFrame, features: Sequence[str], label: str = LABEL, validation: DataFrame | None = None) -> Family:
        """The network stops early by the rows of `validation`, or by a fifth of the training rows where there are none."""
        self.features = list(features)
        made = FAMILIES[self.name](**self.parameters, seed=self.seed)
        if isinstance(made, Boosted):
            self.fitted = made.fit(train, self.features, label)
            return self
        if isinstance(made, Network):
            if validation is None:
                fifth = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in self.features), F.lit(self.seed)), F.lit(5)) == 0
                train, validation = train.filter(~fifth), train.filter(fifth)
            self.fitted = made.fit(train, self.features, label, validation)
            return self
        if isinstance(made, Kernel):
            made.drawn(train, self.features)
            self.waves, made = made, made.estimator()
        estimator = made.setFeaturesCol(VECTOR).setLabelCol(label)
        rows = self.vectors(train.withColumn(label, F.col(label).cast("double"))).withColumn(WEIGHT, balanced(train, label))
        self.fitted = estimator.fit(rows)
        if self.name == "svm":
            margins = self.margins(rows)
            vector = VectorAssembler(inputCols=["_margin"], outputCol="_one").transform(margins)
            self.calibration = ml.LogisticRegression(featuresCol="_one", labelCol=label, weightCol=WEIGHT).fit(vector)
        return self

    def margins(self, rows: DataFrame) -> DataFrame:
        return self.fitted.transform(rows).withColumn("_margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """`df` with the probability of the positive class."""
        if isinstance(self.fitted, (Boosted, Network)):
            return self.fitted.score(df, name)
        rows = self.vectors(df)
        if self.name == "svm":
            a, b = float(self.calibration.coefficients[0]), float(self.calibration.intercept)
            return self.margins(rows).withColumn(name, 1 / (1 + F.exp(-(F.col("_margin") * a + b)))).drop(VECTOR, "_margin")
        scored = self.fitted.transform(rows).withColumn(name, vector_to_array("probability")[1])
        return scored.select(*df.columns, name)

    def importances(self) -> dict[str, float]:
        """Features by their importance to a tree family, or the size of their coefficients."""
        values = self.fitted.featureImportances if hasattr(self.fitted, "featureImportances") else getattr(self.fitted, "coefficients", None)
        return dict(zip(self.features, np.abs(values.toArray()).tolist(), strict=True)) if values is not None else {}


def linear_contributions(family: Family, df: DataFrame, key: str, means: Mapping[str, float]) -> DataFrame:
    """What each feature adds to a linear model's log odds: coefficient * (value - mean), one row for each."""
    pairs = zip(family.features, family.fitted.coefficients.toArray().tolist(), strict=True)
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), ((F.col(f) - means[f]) * c).alias("value")) for f, c in pairs)))
    return df.select(key, parts.alias("_p")).select(key, "_p.feature", "_p.value")


def permutation_contributions(score: Callable[[DataFrame], DataFrame], explain: DataFrame, background: pd.DataFrame, key: str, features: Sequence[str], orders: int = 4, seed: int = 1) -> DataFrame:
    """Shapley values by permutations, against background rows.

    For each row to explain, features are set to its own values one after the other in
    random orders and in their reverses, starting from a background row; what the
    score gains is the feature's.  All rows so made are scored in one pass.  The
    background is a small frame of the caller's.
    """
    rng = np.random.default_rng(seed)
    plans = [p for _ in range(orders) for p in (lambda o: (o, o[::-1]))(rng.permutation(len(features)))]
    values = background[list(features)].to_numpy(float)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, own in zip(batch[key], batch[list(features)].to_numpy(float), strict=True):
                for p, order in enumerate(plans):
                    now = values[p % len(values)].copy()
                    rows.append((k, p, -1, *now))
                    for step, f in enumerate(order):
                        now[f] = own[f]
                        rows.append((k, p, step, *now))
            yield pd.DataFrame(rows, columns=[key, "_plan", "_step", *features])

    made = explain.select(key, *features).mapInPandas(walked, f"{key} {explain.schema[key].dataType.simpleString()}, _plan int, _step int, " + ", ".join(f"`{f}` double" for f in features))
    scored = score(made).select(key, "_plan", "_step", "score")
    before = scored.select(key, "_plan", (F.col("_step") + 1).alias("_step"), F.col("score").alias("_before"))
    gains = scored.join(before, [key, "_plan", "_step"])
    names = F.array(*(F.array(*(F.lit(features[f]) for f in order)) for order in plans))
    named = gains.select(key, F.element_at(F.element_at(names, F.col("_plan") + 1), F.col("_step") + 1).alias("feature"), (F.col("score") - F.col("_before")).alias("_gain"))
    return named.groupBy(key, "feature").agg((F.sum("_gain") / len(plans)).alias("value"))
