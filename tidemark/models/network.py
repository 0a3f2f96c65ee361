"""A network of tanh layers, trained on minibatches that are spread over the cluster.

A step sums the gradients of all blocks of a batch: in each task, over groups of
tasks, then on the driver, which holds the weights and moves them by Adam with
decoupled decay.  Layers are normalised within each block while training, and by
running means after it; units drop out by a mask that the seed, the step and the
block determine.  After each round the validation rows are ranked; the rate is
halved when that stops rising, and training ends when it has not risen for
`patience` rounds, with the weights of the best round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.blocks import Block, packed, summed
from tidemark.operators.statistics import ranking_metrics

TINY, KEPT_SHARE = 1e-5, 0.9
FIRST, SECOND, FLOOR = 0.9, 0.999, 1e-8  # of Adam's means, and below its root


@dataclass
class Network:
    hidden: Sequence[int] = (512, 256, 128)
    rate: float = 1e-3
    dropout: float = 0.3
    decay: float = 1e-2
    batch_rows: int = 4096
    rounds: int = 100
    patience: int = 10
    plateau: int = 5
    seed: int = 1
    features: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    means: list[np.ndarray] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def started(self, inputs: int) -> None:
        """Weights, offsets, scale and shift of each hidden layer, then those of the last; and the layers' running means and variances."""
        rng = np.random.default_rng(self.seed)
        self.weights, self.means = [], []
        for below, width in zip([inputs, *self.hidden[:-1]], self.hidden, strict=True):
            bound = below**-0.5
            self.weights += [rng.uniform(-bound, bound, (below, width)), rng.uniform(-bound, bound, width), np.ones(width), np.zeros(width)]
            self.means += [np.zeros(width), np.ones(width)]
        bound = self.hidden[-1] ** -0.5
        self.weights += [rng.uniform(-bound, bound, (self.hidden[-1], 1)), rng.uniform(-bound, bound, 1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        for k in range(len(self.hidden)):
            w, b, scale, shift = self.weights[4 * k : 4 * k + 4]
            mean, variance = self.means[2 * k : 2 * k + 2]
            x = np.tanh((x @ w + b - mean) / np.sqrt(variance + TINY) * scale + shift)
        return (x @ self.weights[-2] + self.weights[-1])[:, 0]

    def slopes(self, block: Block, step: int) -> np.ndarray:
        """The gradient of the block's weighted loss, the layers' means and variances times its rows, its rows and loss, in one vector."""
        rng = np.random.default_rng([self.seed, step, block.number])
        x, kept, moments = block.x, [], []
        for k in range(len(self.hidden)):
            w, b, scale, shift = self.weights[4 * k : 4 * k + 4]
            z = x @ w + b
            mean, variance = z.mean(axis=0), z.var(axis=0)
            moments += [mean * block.rows, variance * block.rows]
            normal = (z - mean) / np.sqrt(variance + TINY)
            out = np.tanh(normal * scale + shift)
            mask = (rng.random(out.shape) >= self.dropout) / (1 - self.dropout)
            kept.append((x, normal, out, mask, variance))
            x = out * mask
        logit = (x @ self.weights[-2] + self.weights[-1])[:, 0]
        loss = float((block.w * (np.logaddexp(0.0, logit) - block.y * logit)).sum())
        d = (block.w * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - block.y))[:, None]
        slopes = [d.sum(axis=0), x.T @ d]
        d = d @ self.weights[-2].T
        for k in range(len(self.hidden) - 1, -1, -1):
            below, normal, out, mask, variance = kept[k]
            d = d * mask * (1 - out * out)
            slopes += [d.sum(axis=0), (d * normal).sum(axis=0)]
            d = d * self.weights[4 * k + 2]
            d = (d - d.mean(axis=0) - normal * (d * normal).mean(axis=0)) / np.sqrt(variance + TINY)
            slopes += [d.sum(axis=0), below.T @ d]
            d = d @ self.weights[4 * k].T
        return np.concatenate([x.ravel() for x in (*slopes[::-1], *moments, np.array([block.rows, loss]))])

    def fit(self, train: DataFrame, features: Sequence[str], label: str, validation: DataFrame) -> Network:
        self.features = list(features)
        self.started(len(self.features))
        counts = train.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
        positives = counts[1] or 0.0
        weight = F.when(F.col(label) == 1, (counts[0] - positives) / max(1.0, positives)).otherwise(1.0)
        batches = max(1, -(-counts[0] // self.batch_rows))
        blocks = packed(train, features, label, weight, batches, self.seed).cache()
        shapes = [w.shape for w in self.weights] + [m.shape for m in self.means]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        rng, rate, step = np.random.default_rng(self.seed), self.rate, 0
        best, best_state, since, level = -1.0, (self.weights, self.means), 0, 0
        self.history = []
        for _ in range(self.rounds):
            for batch in rng.permutation(batches).tolist():
                step += 1
                sums = summed(blocks.filter(F.col("batch") == batch), lambda b, step=step: self.slopes(b, step), int(ends[-1]) + 2)
                if not sums[-2]:
                    continue
                parts = [x.reshape(s) / sums[-2] for x, s in zip(np.split(sums[:-2], ends[:-1]), shapes, strict=True)]
                self.means = [KEPT_SHARE * old + (1 - KEPT_SHARE) * new for old, new in zip(self.means, parts[len(self.weights) :], strict=True)]
                moved = []
                for k, (w, slope) in enumerate(zip(self.weights, parts, strict=False)):
                    first[k] = FIRST * first[k] + (1 - FIRST) * slope
                    second[k] = SECOND * second[k] + (1 - SECOND) * slope * slope
                    to = first[k] / (1 - FIRST**step) / (np.sqrt(second[k] / (1 - SECOND**step)) + FLOOR)
                    moved.append(w * (1 - rate * self.decay) - rate * to)
                self.weights = moved
            area = ranking_metrics(self.score(validation), "score", F.col(label) == 1).first()
            area = area.auc if area else 0.5
            self.history.append(area)
            if area > best:
                best, best_state, since, level = area, (self.weights, self.means), 0, 0
            else:
                since, level = since + 1, level + 1
                if level > self.plateau:
                    rate, level = rate / 2, 0
                if since >= self.patience:
                    break
        self.weights, self.means = best_state
        blocks.unpersist()
        return self

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        logits = self.logits

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(self.features)))
            return pd.Series(1 / (1 + np.exp(-np.clip(logits(x), -500, 500))))

        return df.withColumn(name, probability(F.array(*(F.col(f"`{c}`").cast("double") for c in self.features))))
