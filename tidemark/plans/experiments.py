"""Experiments: settings, splits that fit on training rows alone, runs over families and seeds, tables that compare them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.families import FAMILIES, SCALED, build
from tidemark.operators import statistics
from tidemark.operators.selection import exact_quantiles
from tidemark.plans import evaluation
from tidemark.plans.dataset import ablate, same_keys, swap_target
from tidemark.plans.imputation import impute
from tidemark.plans.rules import COLUMNS
from tidemark.sources.stores import content_key, kept_frames
from tidemark.sources.tables import cut_lineage

KEY, TARGET = "CompanyID", "target"
QUARTILES = [0.25, 0.5, 0.75]
CUTS = [("train", 0.6), ("validation", 0.8), ("test", 1.0)]


def processed_datasets(timed: DataFrame, snapshot: DataFrame, horizon: int = 7, oldest_start: int = 2, first_decision: int = 2010, last_year: int = 2024, least_share: float = 0.5, most_in_row: int = 6) -> dict[str, DataFrame]:
    """`controlled` from the timed panel within its horizon, `leakboth` from the snapshot's whole history; the same firms and columns in both."""
    from tidemark.plans.dataset import drop_missing, full_history, one_level, windowed

    if not same_keys(timed, snapshot, [KEY, "Age"]):
        raise ValueError("the two panels don't have the same company-years")
    names = {"Age": "age", "GrowthStageGroup": "stage", "GrowthNextStageGroup": "next_stage", "TimeNextStageGroup": "time_next"}

    def prepared(df: DataFrame) -> DataFrame:
        flags = [c for c, kind in df.dtypes if kind == "boolean"]
        df = one_level(df.withColumns({c: F.col(c).cast("int") for c in flags}), "Gender_CEO", "Female")
        return df.withColumn(TARGET, F.col(TARGET).isin("Later", "Exit").cast("int"))

    panel = timed.withColumnsRenamed(names)
    start = windowed(panel, horizon, oldest_start, last_year - horizon, first_decision, KEY, "YearFounded")
    controlled = prepared(start.drop("stage", "next_stage", "time_next").withColumnRenamed("age", "Age"))
    controlled = drop_missing(controlled, least_share, most_in_row)
    features = [c for c in COLUMNS if c not in (KEY, "GrowthStageGroup", "GrowthNextStageGroup", "TimeNextStageGroup")]
    means = {c: c for c in ("N_Competitors", "Same_Country", "SimilarityScoreMean", "UndisclosedAmountShare")}
    last = [c for c in features if c not in ("TotalRaised", *means)]
    whole = full_history(snapshot, start.select(KEY, TARGET), ["TotalRaised"], means, last, KEY, "Age")
    leak = prepared(whole).join(controlled.select(KEY), KEY, "left_semi").select(*controlled.columns)
    return {"controlled": controlled, "leakboth": leak}


@dataclass(frozen=True)
class Split:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    features: list[str]


def group_labels(df: DataFrame, column: str, table: DataFrame | None) -> DataFrame:
    """`df` with _group: the column's own values, or, where its shares are encoded, those of the table and `Others` for the rest."""
    if table is None:
        return df.withColumn("_group", F.col(f"`{column}`").cast("string"))
    kept = table.filter("category <> 'Others'").select(F.col("category").cast("string").alias("_kept"))
    return df.join(F.broadcast(kept), F.col(f"`{column}`").cast("string") == F.col("_kept"), "left").withColumn("_group", F.coalesce("_kept", F.lit("Others"))).drop("_kept")  # one row for each share of at least some size


def robust_scaled(df: DataFrame, fit: DataFrame, features: Sequence[str], group: str | None = None, whole: Sequence[str] = ()) -> DataFrame:
    """(value - median) / quartile range of the rows of `fit`, all features at once; with `group` by its values, but over all for the features in `whole` and for rows whose group `fit` lacks."""
    long = F.inline(F.array(*(F.struct(F.lit(c).alias("_feature"), F.col(f"`{c}`").cast("double").alias("_value")) for c in features)))
    middle = lambda q: F.struct(q[1].alias("m"), F.when(q[2] == q[0], 1.0).otherwise(q[2] - q[0]).alias("s"))
    of_all = {r[0]: r[1] for r in exact_quantiles(fit.select(long), "_value", QUARTILES, ["_feature"]).select("_feature", middle(F.col("_q"))).collect()}  # one row for each feature
    if group:
        by_group = exact_quantiles(fit.filter(F.col(group).isNotNull()).select(F.col(group).alias("_of"), long), "_value", QUARTILES, ["_of", "_feature"])
        stats = by_group.groupBy("_of").agg(F.map_from_entries(F.collect_list(F.struct("_feature", middle(F.col("_q"))))).alias("_stats"))
        df = df.join(stats, F.col(group) == F.col("_of"), "left")
    scaled = {}
    for c in features:
        if c not in of_all:
            continue
        m, spread = F.lit(of_all[c]["m"]), F.lit(of_all[c]["s"])
        if group and c not in whole:
            own = F.try_element_at("_stats", F.lit(c))
            m, spread = F.coalesce(own["m"], m), F.coalesce(own["s"], spread)
        scaled[c] = (F.col(f"`{c}`") - m) / spread
    return df.withColumns(scaled).drop("_of", "_stats")


def prepare_split(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], seed: int, group: str | None = None, least_share: float = 0.01, neighbours: int = 5, strata: DataFrame | None = None, impute_by: str | None = None) -> Split:
    """Stratified parts (by the target of `strata`, a data set of the same firms, if given, else by the own one), with categories as training shares, holes filled from the nearest training rows by all features (`impute_by` a column: of the same group) and features scaled by training quartiles (by `group` if given, else over all)."""
    place = F.xxhash64(F.col(KEY), F.lit(seed))
    if strata is None:
        parted = statistics.stratified_split(df, [TARGET] + ([group] if group else []), place, CUTS)
    else:
        # settings with other targets or columns test the same firms
        if not same_keys(df, strata, [KEY]):
            raise ValueError("the data set doesn't have the firms that its parts are drawn by")
        parts = statistics.stratified_split(strata.select(KEY, TARGET), [TARGET], place, CUTS).select(KEY, "split")
        parted = df.join(parts, KEY)
    out, features, tables = parted.withColumns({c: F.col(c).cast("double") for c in numbers}), list(numbers), {}
    for c in categories:
        tables[c] = statistics.frequency_table(parted.filter("split = 'train'"), c, least_share)
        out = statistics.apply_frequencies(out, c, tables[c], f"{c}_share")
        features.append(f"{c}_share")
    if impute_by:
        out = group_labels(out, impute_by, tables.get(impute_by))
    out = cut_lineage(out)
    out = impute(out, KEY, features, neighbours, out.filter("split = 'train'"), "_group" if impute_by else None)
    if group:
        out = group_labels(out, group, tables.get(group))
    out = cut_lineage(out)
    out = robust_scaled(out, out.filter("split = 'train'"), features, "_group" if group else None, [group, f"{group}_share"])
    out = out.select(KEY, TARGET, "split", *features, *([group] if group and group not in features else []))
    return Split(*(out.filter(F.col("split") == part) for part, _ in CUTS), features)


def kept_split(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], seed: int, folder: str, tag: str, force: bool = False, **options) -> Split:
    """`prepare_split`, kept below `folder` by tag, seed, content and options."""
    strata = options.get("strata")
    parameters = {k: v for k, v in options.items() if k != "strata"} | {"categories": sorted(categories), "numbers": list(numbers), "strata": None if strata is None else content_key(strata.select(KEY, TARGET), {})}

    def build() -> tuple[dict[str, DataFrame], dict]:
        made = prepare_split(df, categories, numbers, seed, **options)
        return {"train": made.train, "validation": made.validation, "test": made.test}, {"features": made.features}

    frames, notes = kept_frames(df.sparkSession, folder, tag, seed, df, parameters, build, force)
    return Split(**frames, features=notes["features"])


def run_once(split: Split, family: str, parameters: Mapping | None, seed: int) -> tuple[dict, DataFrame]:
    """Test metrics at one half and at the threshold of the best validation F1, and the scored test rows."""
    model = build(family, parameters, seed).fit(split.train, split.features, validation=split.validation)
    validation, test = model.score(split.validation), model.score(split.test)
    positive = F.col(TARGET) == 1
    threshold = statistics.best_f1_threshold(validation, "score", positive).first().threshold
    row = statistics.ranking_metrics(test, "score", positive).first()
    out = {"model": family, "seed": seed, "threshold": threshold} | (row.asDict() if row else {})
    out |= statistics.confusion_metrics(test, positive, F.col("score") >= 0.5).first().asDict()
    tuned = statistics.confusion_metrics(test, positive, F.col("score") >= (0.5 if threshold is None else threshold)).first().asDict()
    return out | {f"{k}_tuned": v for k, v in tuned.items()}, test.select(KEY, TARGET, "score").withColumns({"model": F.lit(family), "seed": F.lit(seed)})


def run_grid(df: DataFrame, categories: Sequence[str], numbers: Sequence[str], families: Mapping[str, Mapping], seeds: Sequence[int], group: str | None = None, strata: DataFrame | None = None, impute_by: str | None = None, folder: str | None = None, tag: str = "") -> tuple[list[dict], DataFrame]:
    """Every family on every seed's split, which all families share; with `folder` splits are kept there."""
    metrics, scored = [], []
    for seed in seeds:
        options = {"group": group, "strata": strata, "impute_by": impute_by}
        split = kept_split(df, categories, numbers, seed, folder, tag, **options) if folder else prepare_split(df, categories, numbers, seed, **options)
        for family, parameters in families.items():
            row, predictions = run_once(split, family, parameters, seed)
            metrics.append(row)
            scored.append(predictions)
    return metrics, reduce(DataFrame.unionByName, scored)


def grouped_variants(names: Sequence[str], groups: Mapping[str, str], steps: Sequence[str] = ("impute", "scale", "both")) -> dict[str, dict]:
    """Settings with imputation, scaling or both fitted by a group (its name and column): by tag the setting, the two columns that `run_grid` takes, and the families that the step makes a difference to."""
    fitted = {"impute": (True, False), "scale": (False, True), "both": (True, True)}
    if unknown := set(steps) - set(fitted):
        raise ValueError(f"unknown steps {sorted(unknown)}; there are {', '.join(fitted)}")
    variants = {}
    for name in names:
        for g, column in groups.items():
            for step in steps:
                fill, scale = fitted[step]
                families = [f for f in FAMILIES if f in SCALED] if step == "scale" else list(FAMILIES)
                variants[f"{name}_{step}-{g}"] = {"setting": name, "impute_by": column if fill else None, "group": column if scale else None, "families": families}
    return variants


def settings(controlled: DataFrame, leakboth: DataFrame, without_team: Sequence[str], without_rounds: Sequence[str]) -> dict[str, DataFrame]:
    """The six experiments: both data sets, two ablations, and the two with each other's target."""
    return {
        "controlled": controlled, "leakboth": leakboth, "no_team": ablate(controlled, without_team), "no_rounds": ablate(controlled, without_rounds),
        "leak_features": swap_target(leakboth, controlled, KEY, TARGET), "leak_target": swap_target(controlled, leakboth, KEY, TARGET),
    }


def summary(spark, metrics: Sequence[Mapping]) -> DataFrame:
    """Mean and deviation over seeds by model and metric."""
    names = [m for m in evaluation.METRICS if m in metrics[0]]
    frame = spark.createDataFrame([{"model": m["model"], "seed": m["seed"], **{n: float(m[n]) for n in names}} for m in metrics])
    return evaluation.over_seeds(frame, ["model"], names)
