"""Joins and windows along time: as-of, snapshot, intervals, expansion, next different value, fills and gap filling.

All take explicit order keys and none relies on the order of rows.  A key's history
meets in one task only as far as a window over it needs; the joins have equality on
the key with bounds beside it, so they are hash or merge joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(history: DataFrame, keys: list[str], time: str, until: str = "valid_to") -> DataFrame:
    """Change points as half-open spans: `until` is the next point's time, null for the last.  (keys, time) has to be unique."""
    return history.withColumn(until, F.lead(time).over(Window.partitionBy(*keys).orderBy(time)))


def asof_join(left: DataFrame, history: DataFrame, keys: list[str], left_time: str, time: str, values: list[str]) -> DataFrame:
    """Every row of `left` with the values of the last change point at or before its time, null if there is none.

    Rows and change points of a key are put in one order and the last point seen is
    carried along: one pass, however many of both a key has.  Null keys and times match nothing.
    """
    names = [f"_k{k}" for k in range(len(keys))]
    points = history.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, time])).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    rows = left.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*names).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = points.unionByName(rows, allowMissingColumns=True).withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select("_row.*", *(F.col(f"_seen.{v}").alias(v) for v in values))


def snapshot_join(left: DataFrame, history: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Every row of `left` with its key's last values, whatever the row's own time."""
    last = history.groupBy(*keys).agg(F.max_by(F.struct(*values), time).alias("_last"))
    return left.join(last, keys, "left").select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values))


def expand(df: DataFrame, first: Column, last: Column, name: str, outer: bool = False) -> DataFrame:
    """One row for each whole number from `first` to `last`, falling if last < first; a null bound gives none (outer: one with null)."""
    numbers = F.sequence(first, last)
    return df.withColumn(name, (F.explode_outer if outer else F.explode)(numbers))


def within(left: DataFrame, right: DataFrame, on: list[str], time: str, first: str, last: str, how: str = "inner") -> DataFrame:
    """Interval join: rows of equal keys whose `time` lies from `first` to `last`, both included."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in on})
    condition = [F.col(k) == F.col(f"_{k}") for k in on] + [F.col(time) >= F.col(first), F.col(time) <= F.col(last)]
    return left.join(right, condition, how).drop(*(f"_{k}" for k in on))


def active_sums(left: DataFrame, lives: DataFrame, on: list[str], time: str, first: str, last: str, sums: dict[str, Column]) -> DataFrame:
    """Every row of `left` with sums over the rows of `lives` of equal keys whose life, `first` to `last`, covers its time; 0 where there are none.

    Lives aren't paired with rows: they add to their key's running sums at `first` and
    are taken off after `last`, so that a row looks up one number.
    """
    begun = lives.select(*on, F.col(first).alias("_at"), *(c.alias(n) for n, c in sums.items()))
    ended = lives.select(*on, (F.col(last) + 1).alias("_at"), *((-c).alias(n) for n, c in sums.items()))
    steps = begun.unionByName(ended).groupBy(*on, "_at").agg(*(F.sum(n).alias(n) for n in sums))
    w = Window.partitionBy(*on).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = steps.select(*on, "_at", *(F.sum(n).over(w).alias(n) for n in sums))
    return asof_join(left, running, on, time, "_at", list(sums)).fillna(0, list(sums))


def next_different(df: DataFrame, keys: list[str], order: list[str], value: str, next_name: str, distance_name: str) -> DataFrame:
    """The next value that differs from a row's own, and how many rows away it is.

    Rows without a value are passed over but count in the distance; they get null themselves.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    given = F.col(value).isNotNull()
    # a new run begins where the last value before differs
    before = F.last(F.when(given, F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_row", F.row_number().over(w)).withColumn("_head", given & ~F.col(value).eqNullSafe(before))
    # the next run's head stands after this row
    head = F.when(F.col("_head"), F.struct("_row", F.col(value).alias("v")))
    following = F.first(head, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumn("_next", following)
    return df.withColumns({next_name: F.when(given, F.col("_next.v")), distance_name: F.when(given, F.col("_next._row") - F.col("_row")).cast("long")}).drop("_row", "_head", "_next")


def rows_left(keys: list[str], order: list[str]) -> Column:
    """How many rows of the key come after."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def forward_fill(value: Column, keys: list[str], order: list[str], itself: bool = True) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1))


def backward_fill(value: Column, keys: list[str], order: list[str], itself: bool = True) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0 if itself else 1, Window.unboundedFollowing))


def fill_gaps(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Missing whole numbers spaced evenly between the known ones around them; at the ends they stay null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    missing = F.col(value).isNull()
    df = df.withColumns({
        "_low": forward_fill(F.col(value), keys, order, itself=False),
        "_high": backward_fill(F.col(value), keys, order, itself=False),
        "_gap": F.count(value).over(running),
    })
    gap = Window.partitionBy(*keys, "_gap")
    df = df.withColumns({"_at": F.sum(missing.cast("int")).over(gap.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), "_size": F.sum(missing.cast("int")).over(gap)})
    low, high = F.col("_low"), F.col("_high")
    even = F.floor(low + (high - low) * F.col("_at") / (F.col("_size") + 1) + 0.5)
    return df.withColumn(name, F.when(missing, F.when(low.isNotNull() & high.isNotNull(), even)).otherwise(F.col(value)).cast("long")).drop("_low", "_high", "_gap", "_at", "_size")
