"""Exact order statistics without a task that holds all values.

A rank is found by counting values in blocks between a least and a greatest value,
which are summed before they are shuffled; the block that holds the rank is cut
into blocks again, until its values are equal or few enough for one task.  Each
round reads the rows once.  Medians of growing sets are kept by merging sorted runs
along a key's times; a key of very many rows is cut by its values instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import cut_lineage

#: Blocks of a range; values that one task may put in order; rows of a key whose running medians one task may find.
BLOCKS, FEW, KEY_ROWS = 1024, 1 << 16, 1 << 20
#: Values of a part of a key of more rows, about; times up to which runs are merged.
PART_ROWS, MOST_RUNS = 1 << 18, 256


def key_of(keys: Sequence[str]) -> Column:
    """The keys as one value; nulls in it are equal."""
    return F.struct(*(F.col(f"`{k}`") for k in keys)) if keys else F.struct(F.lit(0).alias("all"))


def block_of(value: Column, low: Column, high: Column, kind: T.DataType) -> Column:
    """A number that grows with the value, 0 for `low` and BLOCKS - 1 for `high`; values that aren't finite are blocks of their own."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        gap = lambda a: F.coalesce(F.try_subtract(a.cast("long"), low.cast("long")).cast("double"), a.cast("double") - low.cast("double"))
        odd: Column = F.lit(False)
        apart: Column = F.lit(0)
    else:
        gap = lambda a: a.cast("double") / 2 - low.cast("double") / 2
        infinite = float("inf")
        odd = F.isnan(high.cast("double")) | (high.cast("double") == infinite) | (low.cast("double") == -infinite)
        number = value.cast("double")
        apart = F.when(F.isnan(number), 3).when(number == infinite, 2).when(number == -infinite, 0).otherwise(1)
    share = F.coalesce(F.floor(F.try_divide(gap(value), gap(high)) * BLOCKS).cast("int"), F.lit(0))
    return F.when(odd, apart).when(value == high, BLOCKS - 1).otherwise(F.greatest(F.lit(0), F.least(share, F.lit(BLOCKS - 1)))).cast("int")


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """_key, _target, _value and _below: for each rank (from 0) asked of a key the value there, and how many of the key's values are less.

    `rows` has no null values; `ranks` has _key (see `key_of`), _target (a name for the
    rank, distinct by key; a few) and _rank, which has to be below the key's count.
    """
    values = rows.select(key_of(keys).alias("_key"), F.col(f"`{value}`").alias("_v"))
    kind = values.schema["_v"].dataType
    where = ["_key", "_low", "_high"]
    ends = values.groupBy("_key").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    state = cut_lineage(ranks.select("_key", "_target", F.col("_rank").cast("long")).join(ends, "_key").withColumn("_below", F.lit(0).cast("long")))

    def within(ranges: DataFrame) -> DataFrame:
        return values.join(ranges.select(*where).distinct(), "_key").filter(F.col("_v").between(F.col("_low"), F.col("_high")))

    while True:
        wide = (F.col("_low") < F.col("_high")) & (F.col("_n") > FEW)
        open_ = state.filter(wide)
        if open_.isEmpty():
            break
        blocks = within(open_).groupBy(*where, block_of(F.col("_v"), F.col("_low"), F.col("_high"), kind).alias("_block")).agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        before = F.sum("_in").over(Window.partitionBy(*where).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
        placed = blocks.withColumn("_before", F.coalesce(before, F.lit(0).cast("long")))
        held = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in"))
        smaller = open_.join(placed, where).filter(held).select("_key", "_target", (F.col("_rank") - F.col("_before")).alias("_rank"), F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.col("_in").alias("_n"), (F.col("_below") + F.col("_before")).alias("_below"))
        state = cut_lineage(state.filter(~wide).unionByName(smaller))
    equal = state.filter("_low = _high").select("_key", "_target", F.col("_low").alias("_value"), "_below")
    few = state.filter("_low < _high")
    inside = Window.partitionBy(*where).orderBy("_v")  # FEW rows at most
    ranked = within(few).withColumns({"_at": F.row_number().over(inside) - 1, "_less": F.rank().over(inside) - 1})
    exact = few.join(ranked, where).filter("_rank = _at").select("_key", "_target", F.col("_v").alias("_value"), (F.col("_below") + F.col("_less")).alias("_below"))
    return equal.unionByName(exact)


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """The keys and _q, an array: at each share the value there, between two values in proportion.  Keys without values are left out."""
    rows = df.filter(F.col(f"`{value}`").isNotNull()).select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{value}`").cast("double").alias("_v")).withColumn("_key", key_of(keys))
    sizes = cut_lineage(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
    most = sizes.agg(F.max("_n")).first()[0] or 0

    def in_one_task(some: DataFrame) -> DataFrame:
        return some.groupBy("_key").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias("_q"))

    if most <= FEW:
        found = in_one_task(rows)
    else:
        large = sizes.filter(F.col("_n") > FEW)
        place = lambda share: (F.col("_n") - 1) * F.lit(share)
        asked = F.array(*(F.struct(F.lit(2 * k + up).alias("_target"), f(place(share)).cast("long").alias("_rank")) for k, share in enumerate(shares) for up, f in enumerate((F.floor, F.ceil))))
        ranks = large.select("_key", F.inline(asked))
        at = order_statistics(rows.join(large.select("_key"), "_key", "left_semi").drop("_key"), keys, "_v", ranks)
        by_target = at.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_target", "_value"))).alias("_at")).join(large, "_key")  # two for each share

        def between(k: int, share: float) -> Column:
            low, high = F.col("_at")[2 * k], F.col("_at")[2 * k + 1]
            return F.when(low == high, low).otherwise((F.ceil(place(share)) - place(share)) * low + (place(share) - F.floor(place(share))) * high)

        found = by_target.select("_key", F.array(*(between(k, share) for k, share in enumerate(shares))).alias("_q"))
        found = found.unionByName(in_one_task(rows.join(large.select("_key"), "_key", "left_anti")))
    return found.select(*(F.col("_key")[k].alias(k) for k in keys), "_q")


class RankCounts:
    """How many values of each rank are in, as a tree of sums: adding one and finding the nth take as many steps as the number of ranks has bits."""

    def __init__(self, ranks: int) -> None:
        self.sums, self.top = [0] * (ranks + 1), 1 << ranks.bit_length()

    def add(self, rank: int) -> None:
        k = rank + 1
        while k < len(self.sums):
            self.sums[k] += 1
            k += k & -k

    def nth(self, n: int) -> int:
        """The rank of the value that has n values before it."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.sums) and self.sums[at + step] <= n:
                at += step
                n -= self.sums[at]
            step >>= 1
        return at


def medians_so_far(times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct times in order, how many rows and how many values there are up to each, and the values' median; what is no number is no value."""
    distinct, counts = np.unique(times, return_counts=True)
    rows = np.cumsum(counts)
    known = ~np.isnan(values)
    times, values = times[known], values[known]
    order = np.lexsort((values, times))
    times, values = times[order], values[order]
    ends = np.searchsorted(times, distinct, side="right")
    medians = np.full(len(distinct), np.nan)
    if len(distinct) <= MOST_RUNS:
        run, begin = values[:0], 0
        for k, end in enumerate(ends.tolist()):
            run = np.insert(run, np.searchsorted(run, values[begin:end]), values[begin:end])
            begin = end
            if end:
                medians[k] = run[(end - 1) // 2] / 2 + run[end // 2] / 2 if run[(end - 1) // 2] != run[end // 2] else run[end // 2]
        return distinct, rows, ends, medians
    ranked = np.sort(values)
    rank, counts, begin = np.searchsorted(ranked, values).tolist(), RankCounts(len(ranked)), 0
    seen = np.zeros(len(ranked), np.int64)
    for k, end in enumerate(ends.tolist()):
        for r in rank[begin:end]:
            counts.add(r + int(seen[r]))  # equal values take ranks of their own
            seen[r] += 1
        begin = end
        if end:
            low, high = (ranked[counts.nth(n)] for n in ((end - 1) // 2, end // 2))
            medians[k] = low / 2 + high / 2 if low != high else low
    return distinct, rows, ends, medians


def running_medians(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """By key and time: _rows, how many rows there are up to that time, _n, how many of them have a value, and these values' _median.  Rows without a time are left out.

    Keys of up to KEY_ROWS rows are shuffled once, each to one task.
    """
    rows = df.filter(F.col(f"`{time}`").isNotNull()).select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{time}`").alias("_time"), F.col(f"`{value}`").cast("double").alias("_v"))
    rows = rows.withColumn("_key", key_of(keys))
    kind = rows.schema["_key"].dataType.simpleString()
    clock = rows.schema["_time"].dataType
    schema = f"_key {kind}, _time {clock.simpleString()}, _rows long, _n long, _median double"
    large = cut_lineage(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > KEY_ROWS).select("_key"))

    def of_key(group: pa.Table) -> pa.Table:
        stamps = group.column("_time").combine_chunks().dictionary_encode()
        names = stamps.dictionary
        order = pc.sort_indices(names)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        distinct, counts, ends, medians = medians_so_far(place[stamps.indices.to_numpy()], group.column("_v").to_numpy())
        return pa.table({"_key": pa.array([group.column("_key")[0].as_py()] * len(distinct), group.schema.field("_key").type), "_time": names.take(order), "_rows": counts, "_n": ends, "_median": pa.array(medians, from_pandas=True)})

    if large.isEmpty():
        found = rows.select("_key", "_time", "_v").groupBy("_key").applyInArrow(of_key, schema)
    else:
        found = rows.join(large, "_key", "left_anti").select("_key", "_time", "_v").groupBy("_key").applyInArrow(of_key, schema).unionByName(medians_by_parts(rows.join(large, "_key", "left_semi").select("_key", "_time", "_v"), schema))
    return found.select(*(F.col("_key")[k].alias(k) for k in keys), F.col("_time").alias(time), "_rows", "_n", "_median")


def medians_by_parts(rows: DataFrame, schema: str) -> DataFrame:
    """The same where keys have very many rows: these are cut into parts by their values, and counts by part and time tell which part holds the middle of each time."""
    parts = -(-rows.count() // PART_ROWS)
    cut = cut_lineage(rows.repartitionByRange(parts, "_key", F.col("_v").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    known = cut.filter(F.col("_v").isNotNull())
    counts = known.groupBy("_key", "_part", "_time").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each time of a part, also if nothing is new there: parts and times of a key are few against its rows
    grid = counts.select("_key", "_part").distinct().join(cut.select("_key", "_time").distinct(), "_key").join(counts, ["_key", "_part", "_time"], "left").fillna(0, ["_n"])
    so_far = grid.withColumn("_here", F.sum("_n").over(Window.partitionBy("_key", "_part").orderBy("_time")))
    by_time = Window.partitionBy("_key", "_time").orderBy("_part")
    so_far = so_far.withColumns({"_below": F.sum("_here").over(by_time) - F.col("_here"), "_all": F.sum("_here").over(Window.partitionBy("_key", "_time"))})
    middles = F.array(F.floor((F.col("_all") - 1) / 2).cast("long"), F.floor(F.col("_all") / 2).cast("long"))
    wanted = so_far.withColumn("_rank", F.explode(F.array_distinct(middles))).filter((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_here")))
    wanted = wanted.select(*(F.col(c).alias(c) for c in ("_key", "_part", "_time")), (F.col("_rank") - F.col("_below")).alias("_rank"))
    kind, clock = rows.schema["_key"].dataType.simpleString(), rows.schema["_time"].dataType.simpleString()

    def picked(part: pa.Table, asked: pa.Table) -> pa.Table:
        """The values of the ranks asked among the part's rows up to each time."""
        columns = {"_key": asked.column("_key"), "_time": asked.column("_time")}
        if not asked.num_rows:
            return pa.table({**columns, "_v": pa.array([], pa.float64())})
        part = part.sort_by("_v")
        values, stamps = part.column("_v").to_numpy(), part.column("_time")
        found = []
        for stamp, rank in zip(asked.column("_time"), asked.column("_rank").to_pylist(), strict=True):
            found.append(values[np.flatnonzero(pc.less_equal(stamps, stamp).to_numpy())[rank]])
        return pa.table({**columns, "_v": pa.array(found, pa.float64())})

    values = known.groupBy("_key", "_part").cogroup(wanted.groupBy("_key", "_part")).applyInArrow(picked, f"_key {kind}, _time {clock}, _v double")
    medians = values.groupBy("_key", "_time").agg(F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(F.min("_v") / 2 + F.max("_v") / 2).alias("_median"))
    totals = so_far.groupBy("_key", "_time").agg(F.max("_all").alias("_n"))
    rows_so_far = F.sum("_new").over(Window.partitionBy("_key").orderBy("_time"))  # a row for each time of the key
    times = cut.groupBy("_key", "_time").agg(F.count(F.lit(1)).alias("_new")).withColumn("_rows", rows_so_far).drop("_new").join(totals, ["_key", "_time"], "left").join(medians, ["_key", "_time"], "left")
    return times.select("_key", "_time", "_rows", F.coalesce("_n", F.lit(0).cast("long")).alias("_n"), "_median")
