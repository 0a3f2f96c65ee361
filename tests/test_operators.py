"""The laws of the panel's operators on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import semantics as sem
from tidemark.operators import states, statistics, temporal


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_dates(spark):
    texts = ["03/04/2019", "03/04/19", "03/04/25", "1/5/2024", "13/45/2001", "2019", None, "02/30/19", "N/A"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("d", sem.parse_date(F.col("t")))
    expected = [dt.date(2019, 3, 4), dt.date(2019, 3, 4), dt.date(1925, 3, 4), dt.date(2024, 1, 5), None, None, None, None, None]
    assert [r.d for r in df.orderBy("k").collect()] == expected


def test_scrub(spark):
    df = spark.createDataFrame([("NA", float("nan"), 1), ("", float("inf"), 2), ("x", 1.5, None), (None, None, 3)], "s string, x double, n int")
    assert rows(sem.scrub(df).orderBy("n"), "s", "x", "n") == [("x", 1.5, None), (None, None, 1), (None, None, 2), (None, None, 3)]


def test_first_match_in_order(spark):
    df = spark.createDataFrame([("MBA and PhD",), ("mba",), (None,), ("none",)], "d string")
    assert [r[0] for r in df.select(sem.first_match(F.col("d"), [("phd", "P"), ("MBA", "M")], "Other")).collect()] == ["P", "M", "Other", "Other"]


def test_tri_state(spark):
    df = spark.createDataFrame([(1, "R"), (1, None), (2, None), (2, "A"), (3, "A")], "g int, s string")
    out = df.groupBy("g").agg(sem.tri_state(F.col("s") == "R", F.col("s").isNull()).alias("t")).orderBy("g")
    assert rows(out, "g", "t") == [(1, True), (2, None), (3, False)]


def test_next_different_passes_over_missing(spark):
    stages = [None, "Seed", "Early", "Early", "Later", "Later"]
    df = spark.createDataFrame([("a", k, s) for k, s in enumerate(stages)], "c string, age int, s string")
    out = temporal.next_different(df, ["c"], ["age"], "s", "n", "t").orderBy("age")
    assert rows(out, "n", "t") == [(None, None), ("Early", 1), ("Later", 2), ("Later", 1), (None, None), (None, None)]


def test_next_different_counts_missing_rows(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "x"), ("a", 3, "y")], "c string, age int, s string")
    assert rows(temporal.next_different(df, ["c"], ["age"], "s", "n", "t").orderBy("age"), "n", "t") == [("y", 3), (None, None), ("y", 1), (None, None)]


def test_running_states(spark):
    df = spark.createDataFrame([("a", 0, None, 1.0, 10.0, 0), ("a", 1, True, None, None, 5), ("a", 2, False, 3.0, 20.0, 1), ("a", 3, None, 4.0, 40.0, 3)], "g string, o int, f boolean, x double, v double, w int")
    w = states.so_far(["g"], ["o"])
    out = df.select("o", states.cumulative_any(F.col("f"), w).alias("a"), states.poisoned_sum(F.col("x"), w).alias("p"), states.weighted_mean_so_far(F.col("v"), F.col("w"), w).alias("m")).orderBy("o")
    assert rows(out, "a", "p", "m") == [(False, 1.0, None), (True, None, None), (True, None, 20.0), (True, None, 35.0)]


def test_truncation_drops_the_terminal_row(spark):
    df = spark.createDataFrame([("a", k, s) for k, s in enumerate(["x", "Exit", "x"])] + [("b", 0, None)], "c string, age int, s string")
    assert rows(states.truncate_at(df, ["c"], ["age"], F.col("s") == "Exit").orderBy("c"), "c", "age") == [("a", 0), ("b", 0)]


def test_gaps_are_spaced_evenly(spark):
    years = [None, 2012, None, None, 2018, None]
    df = spark.createDataFrame([("a", k, y) for k, y in enumerate(years)], "c string, n int, y long")
    assert [r[0] for r in rows(temporal.fill_gaps(df, ["c"], ["n"], "y", "f").orderBy("n"), "f")] == [None, 2012, 2014, 2016, 2018, None]


def test_asof_and_snapshot(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 3), (None, 3)], "k string, t int")
    history = spark.createDataFrame([("a", 2, "x"), ("a", 4, None), ("c", 1, "z")], "k string, y int, v string")
    assert sorted(rows(temporal.asof_join(left, history, ["k"], "t", "y", ["v"]), "k", "t", "v"), key=repr) == sorted([("a", 1, None), ("a", 2, "x"), ("a", 5, None), ("b", 3, None), (None, 3, None)], key=repr)
    assert sorted(rows(temporal.snapshot_join(left, history, ["k"], "y", ["v"]), "k", "t", "v"), key=repr) == sorted([("a", 1, None), ("a", 2, None), ("a", 5, None), ("b", 3, None), (None, 3, None)], key=repr)


def test_sequences_fall_too(spark):
    df = spark.createDataFrame([(3, 1), (1, 1), (None, 2)], "a int, b int")
    assert [r[0] for r in rows(temporal.expand(df, F.col("a"), F.col("b"), "n"), "n")] == [3, 2, 1, 1]


def test_interval_join_includes_both_ends(spark):
    left = spark.createDataFrame([("a", y) for y in (1, 2, 3, 4)], "k string, y int")
    right = spark.createDataFrame([("a", 2, 3, "r")], "k string, f int, t int, v string")
    assert sorted(rows(temporal.within(left, right, ["k"], "y", "f", "t"), "y", "v")) == [(2, "r"), (3, "r")]


def test_expanding_moments(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (2, 5.0)], "t int, v double")
    out = statistics.expanding_moments(df, "t", F.col("v")).orderBy("t").collect()
    assert out[0].deviation is None and out[0].mean == 1.0
    assert out[1].mean == 3.0 and out[1].deviation == pytest.approx(2.0)


def test_frequencies_add_up(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2 + [("c",), (None,)], "c string")
    table = statistics.frequency_table(df, "c", 2 / 12)
    shares = dict(rows(table, "category", "share"))
    assert set(shares) == {"a", "b", "Others"} and sum(shares.values()) == pytest.approx(1)
    unseen = spark.createDataFrame([("z",), (None,), ("a",)], "c string")
    assert [r[0] for r in rows(statistics.apply_frequencies(unseen, "c", table, "s").orderBy("s"), "s")] == pytest.approx([2 / 12, 2 / 12, 8 / 12])


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.5, True), (0.5, False), (0.1, False)], "s double, p boolean")
    row = statistics.ranking_metrics(df, "s", F.col("p")).first()
    assert row.auc == pytest.approx(0.875) and row.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert statistics.best_f1_threshold(df, "s", F.col("p")).first().threshold == 0.5


def test_signed_ranks(spark):
    df = spark.createDataFrame([("f", a, b) for a, b in [(1.0, 0.0), (3.0, 1.0), (0.0, 3.0), (2.0, 2.0)]], "k string, a double, b double")
    row = statistics.signed_ranks(df, F.col("a"), F.col("b"), ["k"]).first()
    assert (row.n, row.w_plus, row.w_minus) == (3, 3.0, 3.0)


def test_dense_numbers(spark):
    df = spark.createDataFrame([("b1",), ("a2",), ("a1",), ("b1",)], "v string")
    assert sorted(rows(statistics.dense_numbers(df, "v", F.substring("v", 1, 1), "n"), "v", "n")) == [("a1", 1), ("a2", 2), ("b1", 3), ("b1", 3)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_peers_are_counted_after_one_shuffle(spark, sf_dir):
    from tidemark.plans.queries import QUERIES

    plan = plan_of(QUERIES["peer_columns_snapshot"](spark, sf_dir))
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(c_custkey") == 1


def test_repeated_pairs_count_one_peer(spark):
    from tidemark.plans.queries import peer_columns

    rows = [(1, 2, True, 1, 0.5), (1, 2, False, 1, 1.0), (1, 3, False, 0, 0.25), (4, 5, False, None, None)]
    found = peer_columns(spark.createDataFrame(rows, "c long, peer long, rival boolean, same_country long, similarity double"), ["c"])
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, round(1.75 / 3, 6), 2), (4, 0, 0, None, 1)]
