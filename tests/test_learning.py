"""Splits, models, contributions and streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models.families import FAMILIES, build, linear_contributions, permutation_contributions
from tidemark.operators import statistics
from tidemark.plans import dataset, evaluation
from tidemark.plans.experiments import prepare_split, run_once, summary
from tidemark.plans.imputation import impute_nearest
from tidemark.streaming.states import running_states, windowed_counts


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for k in range(300):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((k, int(x + 0.3 * rng.gauss(0, 1) > 0), x, y if k % 9 else None, rng.choice("aaaabbbc"), k % 2))
    return spark.createDataFrame(out, "CompanyID long, target int, x double, y double, kind string, half int").cache()


def test_split_fits_on_training_rows_alone(rows):
    split = prepare_split(rows, ["kind"], ["x", "y"], seed=1)
    sizes = [d.count() for d in (split.train, split.validation, split.test)]
    assert sum(sizes) == 300 and abs(sizes[0] - 180) <= 2 and abs(sizes[1] - 60) <= 2
    assert split.features == ["x", "y", "kind_share"]
    median = split.train.agg(F.median("x")).first()[0]
    assert median == pytest.approx(0, abs=1e-9) and split.test.filter("y IS NULL OR kind_share IS NULL").count() == 0


def test_settings_share_their_parts(rows):
    other = rows.withColumn("target", 1 - F.col("half"))
    parts = [{name: {r.CompanyID for r in getattr(prepare_split(df, [], ["x"], seed=3, strata=rows), name).collect()} for name in ("train", "test")} for df in (rows, other)]
    assert parts[0] == parts[1] and len(parts[0]["test"]) in range(58, 63)
    with pytest.raises(ValueError):
        prepare_split(other.filter("CompanyID > 3"), [], ["x"], seed=3, strata=rows)


def test_signed_ranks_give_probabilities(spark):
    frame = spark.createDataFrame([("a", float(k), float(k) - d) for k, d in enumerate([1.5, 2.0, -0.5, 3.0, 2.0, 4.5, -1.0, 2.5])] + [("b", 1.0, 2.0), ("b", 2.0, 1.0)], "k string, x double, y double")
    found = {r.k: r for r in statistics.signed_ranks(frame, F.col("x"), F.col("y"), ["k"]).collect()}
    assert (found["a"].w_plus, found["a"].w_minus) == (33.0, 3.0) and found["a"].p_value == pytest.approx(0.03526, abs=5e-4)
    assert found["b"].p_value == pytest.approx(1.0)


def test_imputation_searches_all_known_rows(spark):
    n = 60_000
    rows = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3000 != 7, F.col("id") * 2.0).alias("y"))
    odd = spark.createDataFrame([(n, None, None), (n + 1, None, None)], "k long, x double, y double")
    found = {r.k: r.y for r in impute_nearest(rows.union(odd), "k", ["x"], "y").filter(f"k % 3000 = 7 OR k >= {n}").collect()}
    # the two rows on each side, and of the third ones the one of smaller key
    assert found == {k: 2.0 * (5 * k - 3) / 5 for k in range(7, n, 3000)} | {n: 4.0, n + 1: 4.0}


@pytest.mark.parametrize("family", ["lr", "dt", "svm"])
def test_families_learn(spark, rows, family):
    split = prepare_split(rows, [], ["x"], seed=2)
    metrics, scored = run_once(split, family, None, 2)
    assert metrics["auc"] > 0.85 and metrics["accuracy"] > 0.75 and scored.filter("score < 0 OR score > 1").count() == 0
    assert [r.metric for r in summary(spark, [metrics]).orderBy("metric").collect()][0] == "accuracy"


def test_unknown_family():
    with pytest.raises(ValueError):
        build("tabpfn")
    assert {"rf", "lgb", "dt", "lr", "svm", "mlp"} == set(FAMILIES)


def test_contributions_add_up(rows):
    model = build("lr").fit(rows.fillna(0.0), ["x", "y"])
    frame = rows.fillna(0.0).limit(3)
    means = {"x": 0.0, "y": 0.0}
    linear = {r.CompanyID: r.s for r in linear_contributions(model, frame, "CompanyID", means).groupBy("CompanyID").agg(F.sum("value").alias("s")).collect()}
    assert len(linear) == 3
    background = pd.DataFrame({"x": [0.0], "y": [0.0]})
    values = permutation_contributions(model.score, frame, background, "CompanyID", ["x", "y"])
    sums = {r.CompanyID: r.s for r in values.groupBy("CompanyID").agg(F.sum("value").alias("s")).collect()}
    base = model.score(rows.sparkSession.createDataFrame([(0.0, 0.0)], "x double, y double")).first().score
    own = {r.CompanyID: r.score - base for r in model.score(frame).collect()}
    assert sums == pytest.approx(own, abs=1e-9)


def test_missing_policy(spark):
    frame = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, 5, None)], "k int, a int, b double")
    assert dataset.drop_missing(frame, 0.6, 5).columns == ["k"] and dataset.drop_missing(frame, 0.7, 0).count() == 0
    assert dataset.one_level(spark.createDataFrame([("Female",), (None,)], "g string"), "g", "Female").agg(F.sum("g_Female")).first()[0] == 1


def test_grid():
    assert evaluation.grid({"model": ["a", "b"], "seed": [1, 2, 3], "x": 5})[-1] == {"model": "b", "seed": 3, "x": 5} and len(evaluation.grid({"m": [1, 2], "s": [1, 2, 3]})) == 6


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "view", 1.0), (1, "2024-01-01 00:01:00", "error", 2.0), (1, "2024-01-01 00:02:00", "view", 4.0), (2, "2024-01-01 00:09:00", "view", 8.0)]
    frame = spark.createDataFrame(rows, "user_id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))

    def result(stream, name, mode):
        query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    source = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    found = result(running_states(source(), "user_id", "ts", "kind", "error"), "states", "append").collect()
    assert sorted((r.user_id, r.n_so_far, r.ended) for r in found) == [(1, 1, False), (1, 2, True), (2, 1, False)]
    counts = result(windowed_counts(source(), "ts", [], "5 minutes", "10 minutes"), "windows", "complete").collect()
    assert sorted((r.n, r.value) for r in counts) == [(1, 8.0), (3, 7.0)]


def test_states_of_a_key_in_several_batches(spark, tmp_path):
    """The order is that of time over the whole micro-batch, though each Arrow batch holds two rows."""
    rows = [(1, f"2024-01-01 00:{m:02d}:00", "error" if m == 7 else "view") for m in (9, 3, 7, 1, 8, 5, 0, 6, 2, 4)]
    frame = spark.createDataFrame(rows, "user_id long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        states = running_states(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "kind", "error")
        query = states.writeStream.outputMode("append").format("memory").queryName("several").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set(name, before)
    found = sorted((r.ts.minute, r.n_so_far, r.ended) for r in spark.table("several").collect())
    assert found == [(m, m + 1, m == 7) for m in range(8)]
