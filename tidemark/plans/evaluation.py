"""Tables that compare runs, models and features."""

from __future__ import annotations

import itertools
import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import statistics

#: The order in which metrics stand in a table.
METRICS = ["auc", "average_precision", "lift", "f1", "accuracy", "precision", "recall", "prevalence"]
#: The order in which families of models stand in a table.
MODELS = ["lr", "dt", "rf", "lgb", "svm", "mlp", "tabpfn"]


def long_metrics(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row for each run and metric."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return runs.select(*(c for c in runs.columns if c not in metrics), pairs.alias("_m")).select("*", "_m.metric", "_m.value").drop("_m")


def over_seeds(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and deviation over seeds (0 for one seed) by key and metric."""
    return long_metrics(runs, metrics).groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation"))


def compare_models(runs: DataFrame, by: str, metrics: Sequence[str], first: str, second: str, digits: int = 4) -> DataFrame:
    """Rounded means side by side, and the change from the first to the second in percent of those."""
    means = over_seeds(runs, [by], metrics).withColumn("mean", F.round("mean", digits))
    wide = means.groupBy("metric").pivot(by, [first, second]).agg(F.first("mean"))
    change = F.round(100.0 * (F.col(second) - F.col(first)) / F.when(F.col(first) != 0, F.col(first)), 6)
    return wide.withColumn("change", change).orderBy(F.array_position(F.lit(METRICS), F.col("metric")))


def metric_place(metric: str) -> tuple[int, str]:
    """Where a metric stands in a table: area under the curve, average precision and its lift, then F1, precision, recall and accuracy (that of training rows last), all others after them by name."""
    name = " ".join(metric.lower().replace("_", " ").replace("-", " ").split())
    exact = {"ap": 1, "average precision": 1, "ap lift": 2, "lift": 2}
    if name in exact:
        return exact[name], metric.lower()
    for place, part in ((0, "auc"), (3, "f1"), (3, "f 1"), (4, "prec"), (5, "rec"), (6, "acc")):
        if part in name:
            return (7 if part == "acc" and "train" in name else place), metric.lower()
    return 99, metric.lower()


def model_place(model: Column) -> Column:
    """Where a model stands in a table: by the family that its name begins with, all others after them."""
    known = [F.when(F.lower(model).startswith(m), k) for k, m in enumerate(MODELS)]
    return F.coalesce(*known, F.lit(len(MODELS)))


def cell(mean: Column, deviation: Column, digits: int, latex: bool) -> Column:
    """A mean and its deviation as text."""
    form = f"%.{digits}f"
    return F.format_string(f"${form} \\pm {form}$" if latex else f"{form} ± {form}", mean, deviation)


def change_cell(first: Column, second: Column, digits: int, latex: bool) -> Column:
    """The change between two means in percent, as a reader of the rounded ones would reckon it; empty from 0."""
    a, b = F.round(first, digits), F.round(second, digits)
    change = (b - a) / F.when(a != 0, a) * 100.0
    sign = F.when(change >= 0, "+").otherwise("-")
    if latex:
        shown = F.format_string("(\\textcolor{%s}{$%s%.1f\\%%$})", F.when(change >= 0, "green!60!black").otherwise("red"), sign, F.abs(change))
    else:
        shown = F.format_string("(%s%.1f%%)", sign, F.abs(change))
    return F.when(change.isNotNull(), shown).otherwise("")


def result_table(runs: DataFrame, metrics: Sequence[str], tags: Sequence[str], digits: int = 3, latex: bool = False) -> DataFrame:
    """One row for each model and each of one or two `tags` that it has runs of, metrics as formatted cells in their order; cells of the second tag end with the change from the first, where the model has runs of both.

    Models stand in the order of their families, a model's tags in the order given.
    """
    if not 1 <= len(tags) <= 2 or len(set(tags)) < len(tags):
        raise ValueError("one tag, or two different ones")
    metrics = sorted(metrics, key=metric_place)
    runs = runs.filter(F.col("tag").isin(list(tags)))
    measured = runs.groupBy("model", "tag").agg(*(F.struct(F.avg(m).alias("mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("deviation")).alias(f"_{k}") for k, m in enumerate(metrics)))
    place = F.array_position(F.lit(list(tags)), F.col("tag"))
    before = Window.partitionBy("model").orderBy(place)  # two rows a model
    cells = []
    for k, m in enumerate(metrics):
        now, then = F.col(f"_{k}"), F.lag(f"_{k}").over(before)
        shown = cell(now["mean"], now["deviation"], digits, latex)
        change = change_cell(then["mean"], now["mean"], digits, latex)
        cells.append(F.when(now["mean"].isNotNull(), F.when(change != "", F.concat_ws(" ", shown, change)).otherwise(shown)).alias(m))
    table = measured.select("model", "tag", place.alias("_tag"), *cells)
    return table.orderBy(model_place(F.col("model")), F.lower("model"), "_tag").drop("_tag")


def drawn(runs: Sequence[Mapping], count: int | None, seed: int = 0) -> list[Mapping]:
    """`count` of the runs of a grid, drawn without repeats and kept in the grid's order; all, if there are no more or no count is given."""
    if count is None or count >= len(runs):
        return list(runs)
    chosen = sorted(random.Random(seed).sample(range(len(runs)), max(count, 0)))
    return [runs[k] for k in chosen]


def importance_ranks(contributions: DataFrame, feature: str, value: str) -> DataFrame:
    """Features by falling mean size of their contributions."""
    sizes = contributions.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), feature)).cast("long"))  # one row for each feature


def rank_shift(first: DataFrame, second: DataFrame, feature: str, value: str, top: int) -> DataFrame:
    """The second experiment's `top` features, their ranks in both, and by how many places they rose."""
    a = importance_ranks(first, feature, value).select(feature, F.col("rank").alias("rank_first"))
    b = importance_ranks(second, feature, value).filter(F.col("rank") <= top).select(feature, F.col("rank").alias("rank_second"))
    return b.join(a, feature).withColumn("shift", F.col("rank_first") - F.col("rank_second")).select(feature, "rank_first", "rank_second", "shift")


def signed_rank_table(first: DataFrame, second: DataFrame, key: str, feature: str, value: str, top: int) -> DataFrame:
    """Of the second experiment's `top` features that the first has too, in the order of their importance there: mean sizes of contributions in both, their difference, the p-value of Wilcoxon's test on the sizes paired by row, and its marks."""
    sizes = [df.select(F.col(key).alias("_row"), F.col(feature).alias("feature"), F.abs(F.col(value).cast("double")).alias(name)) for df, name in ((first, "_first"), (second, "_second"))]
    places = importance_ranks(second, feature, value).filter(F.col("rank") <= top).select(F.col(feature).alias("feature"), "rank")
    pairs = sizes[0].join(sizes[1], ["_row", "feature"]).join(F.broadcast(places), "feature")  # `top` rows
    means = pairs.groupBy("feature", "rank").agg(F.avg("_first").alias("mean_first"), F.avg("_second").alias("mean_second"))
    tests = statistics.signed_ranks(pairs, F.col("_first"), F.col("_second"), ["feature"]).select("feature", "n", "p_value")
    table = means.join(tests, "feature").withColumns({"difference": F.col("mean_first") - F.col("mean_second"), "marks": stars(F.col("p_value"))})
    return table.select("rank", "feature", "mean_first", "mean_second", "difference", "n", "p_value", "marks").orderBy("rank")


def correlations(df: DataFrame, names: Mapping[tuple[str, str], str]) -> DataFrame:
    """Pearson's coefficient of the named pairs, in one pass."""
    return df.agg(*(F.round(F.corr(a, b), 6).alias(n) for (a, b), n in names.items()))


def correlation_pairs(df: DataFrame) -> DataFrame:
    """Of all pairs of numeric columns, one row each."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")]
    pairs = list(itertools.combinations(numeric, 2))
    wide = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def stars(p: Column) -> Column:
    """Significance marks at 0.05 and 0.01."""
    return F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def grid(parameters: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the values that are given as lists."""
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in parameters.items()}
    return [dict(zip(lists, values, strict=True)) for values in itertools.product(*lists.values())]
