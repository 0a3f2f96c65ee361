"""Events made into states: running flags and sums along a key's order, and the cut at a terminal state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.semantics import ratio


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def cumulative_any(flag: Column, w: WindowSpec) -> Column:
    """Whether the flag was true at this row or before; unknown counts as false."""
    return F.max(F.coalesce(flag, F.lit(False)).cast("int")).over(w) == 1


def poisoned_sum(value: Column, w: WindowSpec) -> Column:
    """The running sum, null from the first null on."""
    return F.when(F.max(value.isNull().cast("int")).over(w) == 0, F.sum(value).over(w))


def running_sum(value: Column, w: WindowSpec) -> Column:
    return F.sum(value).over(w)


def weighted_mean_so_far(value: Column, weight: Column, w: WindowSpec) -> Column:
    """The running mean over rows that have a value and a weight above 0; null before the first."""
    valid = value.isNotNull() & (weight > 0)
    return ratio(F.sum(F.when(valid, value * weight)).over(w), F.sum(F.when(valid, weight)).over(w))


def truncate_at(df: DataFrame, keys: list[str], order: list[str], terminal: Column) -> DataFrame:
    """The rows before the key's first terminal one."""
    return df.withColumn("_ended", cumulative_any(terminal, so_far(keys, order))).filter(~F.col("_ended")).drop("_ended")
