import math
import random
import statistics as plain

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection, statistics
from tidemark.plans.evaluation import signed_rank_table


def made(seed, count=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        key = rng.choice(["a", "a", "a", "b", None])
        value = {"a": lambda: rng.choice([1.5, rng.lognormvariate(0, 4)]), "b": lambda: float(rng.randrange(-5, 5)), None: lambda: rng.gauss(1e9, 1e-3)}[key]()
        rows.append((key, rng.randrange(2000, 2012), value if rng.random() > 0.1 else None))
    return [*rows, ("lonely", 2000, 4.0), ("empty", 2001, None)]


def quantile(values, share):
    values = sorted(values)
    at = (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


@pytest.mark.parametrize(("few", "blocks"), [(1 << 16, 1024), (0, 1024), (40, 32)])
def test_quantiles(spark, monkeypatch, few, blocks):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BLOCKS", blocks)
    rows = made(1)
    df = spark.createDataFrame(rows, "key string, year int, value double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r.key: r._q for r in selection.exact_quantiles(df, "value", shares, ["key"]).collect()}
    assert found.keys() == {"a", "b", None, "lonely"}
    for key, q in found.items():
        assert q == [quantile([v for k, _, v in rows if k == key and v is not None], s) for s in shares], key
    (whole,) = selection.exact_quantiles(df, "value", [0.5]).collect()
    assert whole._q == [quantile([v for *_, v in rows if v is not None], 0.5)]
    assert selection.exact_quantiles(df.limit(0), "value", [0.5]).count() == 0


def test_statistics_of_odd_numbers(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 0)
    monkeypatch.setattr(selection, "BLOCKS", 64)
    values = [float("-inf"), -1.7e308, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0, 1.0, 1.7e308, float("inf"), float("inf")]
    longs = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**53, 2**53 + 1, 2**53 + 2, 2**63 - 2, 2**63 - 1, 2**63 - 1]
    for numbers, kind in ((values, "double"), (longs, "long")):
        df = spark.createDataFrame([(x,) for x in random.Random(2).sample(numbers, len(numbers))], f"v {kind}")
        ranks = spark.range(len(numbers)).select(selection.key_of([]).alias("_key"), F.col("id").alias("_target"), F.col("id").alias("_rank"))
        found = {r._target: (r._value, r._below) for r in selection.order_statistics(df, [], "v", ranks).collect()}
        assert found == {k: (x, sum(y < x for y in numbers)) for k, x in enumerate(numbers)}


@pytest.mark.parametrize(("key_rows", "runs"), [(1 << 20, 256), (1 << 20, 0), (50, 256)])
def test_running_medians(spark, monkeypatch, key_rows, runs):
    monkeypatch.setattr(selection, "KEY_ROWS", key_rows)
    monkeypatch.setattr(selection, "PART_ROWS", 100)
    monkeypatch.setattr(selection, "MOST_RUNS", runs)
    rows = [*made(3, 1200), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "key string, year int, value double").repartition(3)
    if runs == 0:  # functions run in workers, which have the module's own setting
        for key in {k for k, *_ in rows}:
            own = [(t, math.nan if v is None else v) for k, t, v in rows if k == key and t is not None]
            times, counts, ends, medians = selection.medians_so_far(np.array([t for t, _ in own]), np.array([v for _, v in own], float))
            for t, c, n, m in zip(times, counts, ends, medians, strict=True):
                seen = [v for u, v in own if u <= t and not math.isnan(v)]
                assert (c, n) == (sum(u <= t for u, _ in own), len(seen)) and (m == pytest.approx(plain.median(seen)) if seen else math.isnan(m))
        return
    found = {(r.key, r.year): (r._rows, r._n, r._median) for r in selection.running_medians(df, ["key"], "year", "value").collect()}
    wanted = {}
    for key, year in {(k, t) for k, t, _ in rows if t is not None}:
        before = [v for k, t, v in rows if k == key and t is not None and t <= year]
        seen = [v for v in before if v is not None]
        wanted[key, year] = (len(before), len(seen), pytest.approx(plain.median(seen)) if seen else None)
    assert found == wanted
    assert selection.running_medians(df.limit(0), ["key"], "year", "value").count() == 0


@pytest.mark.parametrize("few", [1 << 16, 5])
def test_stratified_split_is_the_ranked_one(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(4)
    rows = [(k, rng.choice(["x", "y", None]), rng.randrange(40)) for k in range(700)] + [(900, "alone", 3), (901, "pair", 3), (902, "pair", 1)]
    df = spark.createDataFrame(rows, "id long, s string, p long")
    cuts = [("train", 0.6), ("validation", 0.8), ("test", 1.0)]
    found = {r.id: r.part for r in statistics.stratified_split(df, ["s"], F.struct("p", "id"), cuts, "part").collect()}
    for stratum in {s for _, s, _ in rows}:
        own = sorted((p, k) for k, s, p in rows if s == stratum)
        for i, (_, k) in enumerate(own):
            assert found[k] == next(label for label, cut in cuts if i < math.floor(len(own) * cut + 0.5)), (stratum, k)
    hashed = statistics.stratified_split(df, ["s"], F.xxhash64("id"), cuts).groupBy("s", "split").count().collect()
    assert sum(r["count"] for r in hashed) == len(rows)
    plan = statistics.stratified_split(df, ["s"], F.xxhash64("id"), cuts)._jdf.queryExecution().toString()
    assert "windowspecdefinition(_key" in plan and "_place" in plan  # only rows at a cut are put in order, by key and place


# The greatest rank sum that is significant at 5 % on both sides, by number of pairs, from published tables.
CRITICAL = {6: 0, 7: 2, 8: 3, 9: 5, 10: 8, 11: 10, 12: 13, 13: 17, 14: 21, 15: 25, 16: 29, 17: 34, 18: 40, 19: 46, 20: 52, 21: 58, 22: 65, 23: 73, 24: 81, 25: 89, 30: 137, 40: 264, 50: 434}


def test_exact_tails_agree_with_published_tables():
    for n, w in CRITICAL.items():
        assert statistics.exact_tails(n, w) <= 0.05 < statistics.exact_tails(n, w + 1), n
    assert statistics.exact_tails(5, 0) == 0.0625 and statistics.exact_tails(4, 5) == 1.0
    for n in (1, 4, 9):
        sums = [sum(r + 1 for r in range(n) if m >> r & 1) for m in range(2**n)]
        for w in range(n * (n + 1) // 4 + 1):
            assert statistics.exact_tails(n, w) == min(1.0, 2 * sum(s <= w for s in sums) / 2**n)


def test_signed_ranks(spark):
    rows = [("five", x, 0.0) for x in (1.0, 2.5, 3.0, 4.0, 5.0)] + [("zero", 2.0, 2.0)] * 4 + [("tied", x, 0.0) for x in (1.0, 1.0, -2.0, 3.0)] + [("some", x, 0.0) for x in (0.0, 1.0, 2.0)]
    rows += [("tiny", 1e-20 * k, 0.0) for k in (1, 2, 3)] + [("long", float(k) * (-1) ** k, 0.0) for k in range(1, 61)] + [("null", None, 1.0), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double")
    found = {r.key: r for r in statistics.signed_ranks(df, F.col("a"), F.col("b"), ["key"]).collect()}
    assert found.keys() == {"five", "zero", "tied", "some", "tiny", "long", None}
    assert (found["five"].n, found["five"].w, found["five"].p_value, found["five"].exact) == (5, 0.0, 0.0625, True)
    assert (found["zero"].n, found["zero"].zeros, found["zero"].p_value) == (0, 4, 1.0)
    assert (found["tiny"].w_plus, found["tiny"].p_value) == (6.0, 0.25)
    assert not found["tied"].exact and not found["some"].exact and (found["tied"].w_plus, found["tied"].w_minus) == (7.0, 3.0)
    w = sum(k for k in range(1, 61) if k % 2)
    z = (w - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert found["long"].p_value == pytest.approx(math.erfc(-z / math.sqrt(2))) and not found["long"].exact
    mended = {r.key: r.z for r in statistics.signed_ranks(df, F.col("a"), F.col("b"), ["key"], continuity=True).collect()}
    assert mended["long"] == pytest.approx(z + 0.5 / math.sqrt(60 * 61 * 121 / 24))


def test_signed_rank_table(spark):
    rng = random.Random(6)
    sizes = {"f": (1.0, 3.0), "g": (2.0, 2.0), "h": (0.5, 0.1), "i": (0.2, 0.01)}
    frames = [spark.createDataFrame([(k, f, rng.choice([-1, 1]) * (s[side] + rng.random() / 10)) for k in range(30) for f, s in sizes.items()], "id long, f string, v double") for side in (0, 1)]
    table = signed_rank_table(*frames, "id", "f", "v", top=3).collect()
    assert [(r["rank"], r.feature, r.n) for r in table] == [(1, "f", 30), (2, "g", 30), (3, "h", 30)]
    assert table[0].marks == "**" and table[0].difference < -1.5 and table[2].difference > 0.3 and table[0].p_value == pytest.approx(2 / 2**30)


def test_signed_ranks_of_large_keys_are_the_same(spark, monkeypatch):
    rows = [(k, (i * 7 + k) % 23 - 9.0) for k in range(4) for i in range(5 + 30 * k)] + [(None, 3.0), (None, -3.0), (9, 0.0)]
    df = spark.createDataFrame(rows, "key long, d double")
    ranks = lambda: sorted(map(tuple, statistics.signed_ranks(df, F.col("d"), F.lit(0.0), ["key"]).collect()), key=repr)
    whole = ranks()
    assert len(whole) == 6
    for least in (20, 0):
        monkeypatch.setattr(statistics, "RANKED_ROWS", least)
        for a, b in zip(whole, ranks(), strict=True):
            assert a == pytest.approx(b, nan_ok=True)


def test_signed_ranks_shuffle_pairs_once(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("key"), F.col("id").cast("double").alias("d"))
    plan = statistics.signed_ranks(df, F.col("d"), F.lit(0.0), ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
