import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.models import blocks, network
from tidemark.models.boosting import Boosted
from tidemark.models.contributions import base_value, tree_contributions, trees_of
from tidemark.models.families import build
from tidemark.models.network import Network
from tidemark.operators.statistics import ranking_metrics

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for k in range(600):
        a, b, c = (rng.gauss(0, 1) for _ in NAMES)
        out.append((k, int(a + (b if c > 0 else -b) + 0.3 * rng.gauss(0, 1) > 0.5), a, b, c))
    return spark.createDataFrame(out, "id long, target int, a double, b double, c double").repartition(3, "id").cache()


@pytest.fixture(scope="module")
def rings(spark):
    rng = random.Random(2)
    out = []
    for k in range(400):
        turn, far = rng.uniform(0, 2 * math.pi), 1.0 if k % 2 else 2.5
        out.append((k, k % 2, far * math.cos(turn) + rng.gauss(0, 0.15), far * math.sin(turn) + rng.gauss(0, 0.15)))
    return spark.createDataFrame(out, "id long, target int, a double, b double").cache()


def area(df):
    return ranking_metrics(df, "score", F.col("target") == 1).first().auc


def enumerated(trees, x):
    """Shapley values from all subsets, unknown features going both ways by cover."""
    def value(tree, node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        low, high = tree.children[node]
        if f in known:
            return value(tree, high if x[f] > tree.cut[node] else low, known)
        return sum(tree.cover[k] * value(tree, k, known) for k in (low, high)) / tree.cover[node]

    n, out = len(x), []
    for f in range(n):
        total = 0.0
        for size in range(n):
            for rest in itertools.combinations([k for k in range(n) if k != f], size):
                share = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                total += share * sum(value(t, 0, {*rest, f}) - value(t, 0, {*rest}) for t in trees)
        out.append(total)
    return out


@pytest.mark.parametrize(("family", "parameters"), [("dt", {"depth": 4}), ("rf", {"trees": 3, "depth": 4}), ("lgb", {"rounds": 3, "leaves": 6})])
def test_contributions_equal_all_subsets(rows, family, parameters):
    model = build(family, parameters).fit(rows, NAMES)
    some = rows.filter("id < 12")
    found = {}
    for r in tree_contributions(model.fitted, some, "id", NAMES).collect():
        found.setdefault(r.id, {})[r.feature] = r.value
    trees, base = trees_of(model.fitted), base_value(model.fitted)
    for r in model.score(some).collect():
        own = [found[r.id][c] for c in NAMES]
        assert own == pytest.approx(enumerated(trees, [r.a, r.b, r.c]), abs=1e-9)
        output = math.log(r.score / (1 - r.score)) if family == "lgb" else r.score
        assert base + sum(own) == pytest.approx(output, abs=1e-6)


def test_leaf_limit(rows):
    model = Boosted(rounds=4, leaves=8, least_rows=5).fit(rows, NAMES, "target")
    assert len(model.trees) == 4 and all(t.leaf_count() == 8 for t in model.trees)
    assert max(t.depth() for t in model.trees) > 3  # deeper than a full tree of as many leaves
    shallow = Boosted(rounds=2, leaves=31, depth=2, least_rows=5).fit(rows, NAMES, "target")
    assert all(t.depth() <= 2 for t in shallow.trees)
    assert area(model.score(rows)) > 0.85
    again = Boosted(rounds=4, leaves=8, least_rows=5).fit(rows.repartition(5), NAMES, "target")
    assert [t.feature for t in again.trees] == [t.feature for t in model.trees]


def test_splits_are_the_best(rows):
    """The first split has the greatest gain of all cuts, counted row by row."""
    tree = Boosted(rounds=1, leaves=2, least_rows=1).fit(rows, NAMES, "target").trees[0]
    data = np.array([[r.a, r.b, r.c, r.target] for r in rows.collect()])
    w = np.where(data[:, 3] == 1, (data[:, 3] == 0).sum() / (data[:, 3] == 1).sum(), 1.0)
    g, h = w * (0.5 - data[:, 3]), w * 0.25
    gain = lambda m: g[m].sum() ** 2 / h[m].sum()
    best = max(gain(data[:, f] <= x) + gain(data[:, f] > x) for f in range(3) for x in np.sort(data[:, f])[5:-5])
    side = data[:, tree.feature[0]] <= tree.cut[0]
    assert gain(side) + gain(~side) >= 0.97 * best


def test_waves_separate_rings(rings):
    model = build("svm").fit(rings, ["a", "b"])
    scored = model.score(rings)
    assert area(scored) > 0.98 > 0.7 > area(build("lr").fit(rings, ["a", "b"]).score(rings))
    shares = scored.groupBy((F.col("score") >= 0.5).alias("up")).agg(F.avg("score").alias("said"), F.avg("target").alias("was")).collect()
    assert len(shares) == 2 and all(abs(r.said - r.was) < 0.15 for r in shares)


def test_slopes_are_the_loss_s(rows):
    x = np.random.default_rng(0).normal(0, 1, (7, 3))
    block = blocks.Block({"block": 5, "rows": 7, "x": x.tobytes(), "y": np.array([0.0, 1, 1, 0, 1, 0, 0]).tobytes(), "w": np.linspace(1, 2, 7).tobytes(), "margin": np.zeros(7).tobytes()})
    model = Network(hidden=(4, 3), dropout=0.25, seed=3)
    model.started(3)
    found = model.slopes(block, 2)
    at = 0
    for w in model.weights:
        flat = w.reshape(-1)
        for k in range(flat.size):
            kept, step = flat[k], 1e-6
            flat[k] = kept + step
            up = model.slopes(block, 2)[-1]
            flat[k] = kept - step
            down = model.slopes(block, 2)[-1]
            flat[k] = kept
            assert found[at] == pytest.approx((up - down) / (2 * step), abs=1e-5)
            at += 1


def test_network_stops_by_patience(rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 100)
    train, validation = rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0")
    options = {"hidden": (16, 8), "rounds": 12, "rate": 0.03, "batch_rows": 150, "patience": 2, "dropout": 0.1}
    model = Network(**options).fit(train, NAMES, "target", validation)
    best = max(model.history)
    assert best > 0.8 and area(model.score(validation)) == pytest.approx(best)
    after = len(model.history) - 1 - model.history.index(best)
    assert after == 2 or len(model.history) == 12
    worse = Network(**options | {"rate": 0.0, "rounds": 9}).fit(train, NAMES, "target", validation)
    assert len(worse.history) in range(3, 9)  # the means move a little, the weights don't
    monkeypatch.setattr(blocks, "TOGETHER", 1)  # sums by groups of tasks
    again = Network(**options | {"rounds": 2}).fit(train, NAMES, "target", validation)
    assert again.history == pytest.approx(model.history[:2], abs=1e-3)


def test_family_without_validation(rows):
    model = build("mlp", {"hidden": (8,), "rounds": 3, "rate": 0.05}).fit(rows, NAMES)
    assert isinstance(model.fitted, network.Network) and len(model.fitted.history) <= 3
    assert model.score(rows).filter("score < 0 OR score > 1").count() == 0
