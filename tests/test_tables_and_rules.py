"""Rules from files, tables of results, the example's widths, and the windowed set against a plain version."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.plans import evaluation, people
from tidemark.plans.dataset import windowed
from tidemark.plans.rules import DATE_REPAIR, Rules, load_rules
from tidemark.sources.example import frames_of


def test_rules_from_settings(spark, tmp_path):
    assert Rules.of({}) == Rules()
    assert Rules.of({"first_year": 1990, "other": 1, "panel": {"degree_rules": [["BA", "Bachelor's"]]}}).degree_rules == [("BA", "Bachelor's")]
    with pytest.raises(ValueError, match="no_rule"):
        Rules.of({"panel": {"no_rule": 1}})
    for wrong in ({"date_repair": {"acquired_status": []}}, {"name_degree_patterns": {"Name_X": "x"}}):
        with pytest.raises(ValueError, match="has to have the keys"):
            Rules.of(wrong)
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"panel": {"date_repair": {**DATE_REPAIR, "acquisition_type": "Takeover"}}}))
    assert load_rules(spark, str(path)).date_repair["acquisition_type"] == "Takeover"


def test_titles_follow_the_rules(spark):
    titles = spark.createDataFrame([("Founder",), ("Founder's associate",), ("Originator",)], "t string")
    found = lambda rules: [r.f for r in titles.select(people.is_founder(titles.t, rules).alias("f")).collect()]
    assert found(Rules()) == [True, False, False] and found(Rules(founder_pattern="originat")) == [False, False, True]


def test_order_of_metrics_and_models(spark):
    given = ["Acc (train)", "acc_test", "recall", "zeta", "precision", "F1", "AP lift", "AP", "roc_auc", "beta"]
    assert sorted(given, key=evaluation.metric_place) == ["roc_auc", "AP", "AP lift", "F1", "precision", "recall", "acc_test", "Acc (train)", "beta", "zeta"]
    runs = [("xgb", "a", 0.5), ("RF", "a", 0.5), ("lr", "a", 0.5), ("lgb_2", "a", 0.5), ("abc", "a", 0.5)]
    table = evaluation.result_table(spark.createDataFrame(runs, "model string, tag string, auc double"), ["auc"], ["a"])
    assert [r.model for r in table.collect()] == ["lr", "RF", "lgb_2", "abc", "xgb"]


def test_cells_of_results(spark):
    runs = [("lr", "a", 1, 0.80, 0.0), ("lr", "a", 2, 0.90, 0.0), ("lr", "b", 1, 0.8004, 0.5), ("rf", "b", 1, 0.7, None), ("rf", "c", 1, 0.1, 0.1)]
    frame = spark.createDataFrame(runs, "model string, tag string, seed int, auc double, recall double")
    found = [tuple(r) for r in evaluation.result_table(frame, ["recall", "auc"], ["a", "b"], digits=2).collect()]
    assert found == [("lr", "a", "0.85 ± 0.07", "0.00 ± 0.00"), ("lr", "b", "0.80 ± 0.00 (-5.9%)", "0.50 ± 0.00"), ("rf", "b", "0.70 ± 0.00", None)]
    latex = evaluation.result_table(frame, ["auc"], ["a", "b"], digits=2, latex=True).filter("model = 'lr' AND tag = 'b'").first().auc
    assert latex == "$0.80 \\pm 0.00$ (\\textcolor{red}{$-5.9\\%$})"
    with pytest.raises(ValueError):
        evaluation.result_table(frame, ["auc"], ["a", "a"])


def test_runs_are_drawn_once_each():
    runs = evaluation.grid({"seed": [1, 2, 3], "model": ["lr", "rf"]})
    some = evaluation.drawn(runs, 4)
    assert len(some) == 4 and [r for r in runs if r in some] == some == evaluation.drawn(runs, 4)
    assert evaluation.drawn(runs, None) == runs == evaluation.drawn(runs, 9) and evaluation.drawn(runs, 0) == []


def test_example_tables_have_one_width(spark):
    assert len(frames_of(spark)) == 14
    with pytest.raises(ValueError, match="Fund: a row has 1 values instead of 2"):
        frames_of(spark, {"Fund": ("FundID Vintage", [("a",)])})


def plain_windowed(panel, horizon, oldest, last, first):
    out = []
    for key in {r[0] for r in panel if r[0] is not None}:
        rows = {r[2]: r for r in panel if r[0] == key}
        staged = [a for a, r in rows.items() if r[3] is not None]
        if not staged or min(staged) > oldest or not any(r[3] == "Early" for r in rows.values()):
            continue
        start, end = min(staged), min(min(staged) + horizon, max(staged))
        if end not in rows or not first <= rows[start][1] + start <= last:
            continue
        _, _, age, stage, following, time = rows[end]
        moves = time is not None and age + time <= start + horizon and following is not None and following != "Stay"
        out.append((*rows[start], following if moves else stage))
    return sorted(out, key=str)


STAGES = st.sampled_from(["Early", "Later", "Out", None])
YEARS = st.dictionaries(st.tuples(st.sampled_from([1, 2, 3, None]), st.integers(0, 6)), st.tuples(STAGES, st.sampled_from(["Later", "Exit", "Stay", None]), st.one_of(st.none(), st.integers(0, 4))), max_size=20)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(years=YEARS)
def test_windowed_set_in_one_pass(spark, years):
    panel = [(key, None if key is None else 2000 + key, age, *rest) for (key, age), rest in years.items()]
    frame = spark.createDataFrame(panel, "o_custkey int, first_year int, age int, stage string, next_stage string, time_next int")
    made = windowed(frame, horizon=3, oldest_start=2, last_decision=2004, first_decision=2002)
    assert made.columns == [*frame.columns, "target"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain_windowed(panel, 3, 2, 2004, 2002)
