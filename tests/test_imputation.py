import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cells
from tidemark.plans import imputation

NAMES = ["a", "b", "c", "d"]


def table(seed, count, holes=0.25):
    """Clusters of points with holes in every column."""
    rng = random.Random(seed)
    centres = [[rng.uniform(0, 100) for _ in NAMES] for _ in range(12)]
    rows = []
    for k in range(count):
        centre = rng.choice(centres)
        rows.append((k, rng.choice(["x", "y", "z", None]), *(None if rng.random() < holes else x + rng.gauss(0, 1) for x in centre)))
    return rows


def brute(rows, train, neighbours=5):
    """Filled values by key, from all distances."""
    known = np.array([[np.nan if x is None else x for x in r[2:]] for r in train], float).reshape(-1, len(NAMES))
    keys = np.array([r[0] for r in train])
    order = np.argsort(keys, kind="stable")
    known, out = known[order], {}
    for r in rows:
        own = np.array([np.nan if x is None else x for x in r[2:]], float)
        far = cells.distances(own[None], known)[0]
        filled = own.copy()
        for c in np.flatnonzero(np.isnan(own)):
            have = np.flatnonzero(~np.isnan(known[:, c]) & np.isfinite(far))
            best = have[np.argsort(far[have], kind="stable")[:neighbours]]
            column = known[~np.isnan(known[:, c]), c]
            filled[c] = known[best, c].mean() if len(best) else column.mean() if len(column) else np.nan
        out[r[0]] = filled
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, " + ", ".join(f"{c} double" for c in NAMES))


def equal(df, wanted):
    found = {r.k: np.array([np.nan if r[c] is None else r[c] for c in NAMES]) for r in df.collect()}
    assert found.keys() == wanted.keys()
    for k, x in wanted.items():
        assert np.allclose(found[k], x, equal_nan=True), k


@pytest.mark.parametrize("limits", [{}, {"CELL_ROWS": 16, "PART_ROWS": 7, "SLAB_ROWS": 20, "ROWS_AT_ONCE": 3}])
def test_holes_in_every_column(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(imputation, name, value)
    rows = table(1, 400)
    rows += [(1000, "x", None, None, None, None), (1001, "y", None, 1e9, None, None), (1002, None, float("nan"), 3.0, 4.0, 5.0)]
    rows += [(2000 + k, "x", *rows[5][2:]) for k in range(30)]  # copies
    rows = [(r[0], r[1], *(None if x is not None and math.isnan(x) else x for x in r[2:])) for r in rows]
    train = [r for r in rows if r[0] % 3]
    filled = imputation.impute(frame(spark, rows), "k", NAMES, 5, frame(spark, train))
    assert filled.columns == ["k", "g", *NAMES]
    equal(filled, brute(rows, train))


def test_most_pairs_are_not_looked_at(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(imputation, "CELL_ROWS", 32)
    search = imputation.nearest_in

    def counted(a, b, *more):
        looked.add(len(a) * len(b))
        return search(a, b, *more)

    monkeypatch.setattr(imputation, "nearest_in", counted)
    rows = table(2, 2500, holes=0.06)
    equal(imputation.impute(frame(spark, rows), "k", NAMES), brute(rows, rows))
    asking = sum(None in r[2:] for r in rows)
    assert 0 < looked.value < 0.15 * asking * len(rows)


def test_groups_fall_back_to_all(spark):
    rows = table(3, 300)
    rows = [(k, "lonely" if k % 50 == 0 else g, *x) for k, g, *x in rows]
    rows = [(k, g, None, *x[1:]) if g == "z" else (k, g, *x) for k, g, *x in rows]  # a group that misses a column
    train = [r for r in rows if r[0] % 4 and r[1] != "lonely"]  # and one that isn't trained on
    wanted = brute([r for r in rows if r[1] not in ("x", "y")], train)
    for g in ("x", "y"):
        wanted |= brute([r for r in rows if r[1] == g], [r for r in train if r[1] == g])
    equal(imputation.impute(frame(spark, rows), "k", NAMES, 5, frame(spark, train), group="g"), wanted)


def test_nothing_known(spark):
    rows = [(1, None, 1.0, None, 2.0, 3.0), (2, None, 1.0, None, None, 5.0)]
    found = {r.k: (r.a, r.b, r.c, r.d) for r in imputation.impute(frame(spark, rows), "k", NAMES).collect()}
    assert found == {1: (1.0, None, 2.0, 3.0), 2: (1.0, None, 2.0, 5.0)}
    assert imputation.impute(frame(spark, rows).limit(0), "k", NAMES).count() == 0


def test_bounds_are_below_all_distances():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 3, (600, 5)).round(1)
    points[rng.random(points.shape) < 0.3] = np.nan
    tree = cells.grown(points, 10)
    cell = tree.cells_of(points)
    assert tree.cells > 40 and np.bincount(cell).max() <= 10
    for k in range(tree.cells):
        own = points[cell == k]
        if not len(own):
            continue
        known = (~np.isnan(own)).sum(axis=0)
        low, high = (f(np.where(np.isnan(own), fill, own), axis=0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        box = (np.where(known, low, np.nan)[None], np.where(known, high, np.nan)[None], known[None], np.array([len(own)]), np.isnan(own).sum(axis=1).max(keepdims=True))
        for point in points[:40]:
            assert cells.least_distances(point, *box)[0] <= cells.distances(point[None], own).min() + 1e-9


def test_equal_points_make_one_cell():
    tree = cells.grown(np.tile([1.0, np.nan], (50, 1)), 4)
    assert tree.cells == 1 and set(tree.cells_of(np.array([[1.0, np.nan], [7.0, 2.0]]))) == {0}
