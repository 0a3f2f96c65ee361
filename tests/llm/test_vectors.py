import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import table

SCHEMA = "vec_id long, label int, embedding array<double>, norm string, shelf int, rank int, lows string"


def brute(rows, is_anchor, scale=256, positives=5, negatives=5, low=80, high=100):
    usable = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in vector):
            continue
        usable[vec_id] = min(usable.get(vec_id, (label, vector)), (label, vector))
    whole = {i: (label, [math.floor(scale * x) for x in vector]) for i, (label, vector) in usable.items()}
    score = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(whole[a][1], whole[b][1], strict=False))))
    out = set()
    for a in filter(is_anchor, whole):
        ranked = sorted((-score(a, b), b) for b in whole if b != a)
        for s, p in [x for x in ranked if whole[x[1]][0] == whole[a][0]][:positives]:
            fitting = [(t, n) for t, n in ranked if whole[n][0] != whole[a][0] and low * -s <= 100 * -t <= high * -s]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fitting[:negatives])}
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 1, "y") for r in rows], SCHEMA)


def rows_of(seed, count=300, width=6, spread=1.0):
    rng = random.Random(seed)
    out = []
    for k in range(count):
        length = math.exp(rng.gauss(0, spread))
        out.append((k, rng.randrange(3), [rng.gauss(0, 1) * length for _ in range(width)]))
    return out


ODD = [
    (None, 1, [1.0]), (1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [1.0, None]), (1003, 1, [float("nan")] * 6), (1004, 1, [float("-inf")]), (1005, 1, [1.7e308]),
    (1010, 1, []), (1020, 2, [0.5, 0.5]), (1030, 1, [1.0] * 9), (1031, 0, [1.0] * 9), (1031, 0, [1.0] * 9), (1032, 2, [1.0] * 9), (1032, 1, [2.0] * 9), (-20, 1, [0.25] * 6),
]


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 16, "FEW": 8, "TILE_ROWS": 40, "TOGETHER": 3, "RUNS": 2}])
def test_hard_negatives(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = rows_of(1) + ODD
    found = hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 10 == 0, scale=256, positives=5, negatives=5, low=80, high=100)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda i: i % 10 == 0)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FEW", 16)
    monkeypatch.setattr(hard_negatives, "BUCKET", 32)
    rng = random.Random(3)
    rows = [(k, rng.randrange(2), [1.0, 0.5]) for k in range(200)] + [(k, rng.randrange(2), [float(rng.randrange(3)), float(rng.randrange(3))]) for k in range(200, 300)]
    found = {tuple(r) for r in hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 50 == 0, 1, 3, 4, 50, 100).collect()}
    assert found == brute(rows, lambda i: i % 50 == 0, 1, 3, 4, 50, 100)


def test_numbers_beyond_doubles(spark):
    rng = random.Random(4)
    for size in (2.0**26, 2.0**30, 2.0**40):
        rows = [(k, rng.randrange(2), [float(rng.randrange(-(2**20), 2**20)) * size / 2**20 for _ in range(3)]) for k in range(40)]
        found = {tuple(r) for r in hard_negatives.hard_negatives(made(spark, rows), F.col("vec_id") % 5 == 0, 1, 3, 3, 0, 100).collect()}
        assert found == brute(rows, lambda i: i % 5 == 0, 1, 3, 3, 0, 100)


def test_buckets_are_left_out(monkeypatch):
    """Rows too short for a window aren't scored, nor those that the kth score shuts out."""
    import numpy as np
    import pyarrow as pa

    seen = []
    scored = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda a, b, most: seen.append(len(b)) or scored(a, b, most))
    bucket = lambda norm, ids: {"top": norm, "count": len(ids), "width": 1, "ids": np.array(ids).tobytes(), "labels": np.zeros(len(ids), np.int64).tobytes(), "data": np.full((len(ids), 1), norm).tobytes()}
    shelf = pa.Table.from_pylist([bucket(9.0, [1, 2]), bucket(5.0, [3]), bucket(2.0, [4, 5, 6])])
    anchor = {"vec_id": 0, "label": 0, "vec": [10.0], "norm": 10.0, "lows": [40], "highs": [60]}
    found = hard_negatives.search(pa.Table.from_pylist([anchor]), shelf, True, 2).to_pylist()
    assert [(r["vec_id"], r["score"]) for r in found] == [(3, 50)] and seen == [2, 1]
    seen.clear()
    found = hard_negatives.search(pa.Table.from_pylist([anchor | {"lows": [0], "highs": [99]}]), shelf, True, 2).to_pylist()
    assert [r["vec_id"] for r in found] == [1, 2] and seen == [2]


def test_no_rows(spark, sf_dir):
    assert hard_negatives.hard_negatives(made(spark, []), F.lit(True), 256, 5, 5, 80, 100).count() == 0
    assert hard_negatives.hard_negatives(made(spark, rows_of(5, 20)), F.lit(False), 256, 5, 5, 80, 100).count() == 0


def test_query(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in embeddings]
    assert {tuple(r) for r in QUERIES["op11_norm_buckets"](spark, sf_dir).collect()} == brute(rows, lambda i: i % 100 == 0)
