"""From panels to learning data: windowed and full-history sets, missing values, ablations and target swaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed(panel: DataFrame, horizon: int, oldest_start: int, last_decision: int, first_decision: int | None = None, key: str = "o_custkey", founded: str = "first_year", early: str = "Early") -> DataFrame:
    """One row for each entity that is ever early: its first staged row, with the stage it has reached `horizon` years on.

    The panel has key, founded, age, stage, next_stage ("Stay" for none) and time_next.
    The target looks no further than the horizon, nor than the entity's last staged row.
    """
    whole = Window.partitionBy(key)  # one shuffle: the rows of an entity are as many as its years
    age, staged = F.col("age"), F.when(F.col("stage").isNotNull(), F.col("age"))
    rows = panel.filter(F.col(key).isNotNull()).withColumns({"_first": F.min(staged).over(whole), "_last": F.max(staged).over(whole), "_early": F.bool_or(F.col("stage") == early).over(whole)})
    rows = rows.filter(F.col("_early") & (F.col("_first") <= oldest_start)).withColumn("_target", F.least(F.col("_first") + horizon, F.col("_last")))
    reached = F.when((age + F.col("time_next") <= F.col("_first") + horizon) & (F.col("next_stage") != "Stay"), F.col("next_stage")).otherwise(F.col("stage"))
    rows = rows.withColumns({"_there": F.bool_or(age == F.col("_target")).over(whole), "target": F.max(F.when(age == F.col("_target"), reached)).over(whole)})
    decided = F.col(founded) + age
    kept = rows.filter((age == F.col("_first")) & F.col("_there") & (decided <= last_decision))
    if first_decision is not None:
        kept = kept.filter(decided >= first_decision)
    return kept.select(key, *(c for c in panel.columns if c != key), "target")


def full_history(panel: DataFrame, targets: DataFrame, summed: Sequence[str], averaged: Mapping[str, str], last: Sequence[str], key: str = "o_custkey", order: str = "age") -> DataFrame:
    """The entities of `targets` with their whole history in one row: sums, means (new name: column) and last values."""
    members = panel.join(targets.select(key), key, "left_semi")
    out = members.groupBy(key).agg(*(F.sum(c).alias(c) for c in summed), *(F.avg(c).alias(n) for n, c in averaged.items()), F.max_by(F.struct(*last), order).alias("_last"))
    return out.select(key, *summed, *averaged, *(F.col(f"_last.{c}").alias(c) for c in last)).join(targets, key)


def uncovered(targets: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Entities of `targets` that the panel lacks; there should be none."""
    return targets.join(panel, key, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two panels have the same rows by key."""
    a, b = a.select(*keys), b.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def drop_missing(df: DataFrame, least_share: float, most_in_row: int) -> DataFrame:
    """Without columns that miss `least_share` or more of their values, then without rows that miss more than `most_in_row`."""
    columns = df.columns
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns))).first()
    kept = [c for k, c in enumerate(columns) if row["n"] == 0 or (row["n"] - row[f"c{k}"]) / row["n"] < least_share]
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in kept), F.lit(0))
    return df.select(*(F.col(f"`{c}`") for c in kept)).filter(missing <= most_in_row)


def swap_target(df: DataFrame, other: DataFrame, key: str, target: str = "target") -> DataFrame:
    """The rows of `df` with the target of `other`."""
    return df.drop(target).join(other.select(key, target), key)


def ablate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without some columns; those that aren't there are passed over."""
    return df.drop(*columns)


def one_level(df: DataFrame, column: str, level: str) -> DataFrame:
    """A category as one 0/1 column for a level; missing is 0."""
    return df.withColumn(f"{column}_{level}", F.coalesce((F.col(column) == level).cast("int"), F.lit(0))).drop(column)
