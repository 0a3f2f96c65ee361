"""Missing values filled with the mean of the nearest known rows.

Training rows are put into cells (`tidemark.operators.cells`).  A row with holes is
first sent to those cells whose farthest corners are nearest, until they hold enough rows to fill each of them from; the
distances found there shut out most other cells, and the rest is searched too.  So
the nearest rows are exact, while most pairs of rows are never looked at.

Of equal training points only as many rows as can be neighbours are searched, those
of the least keys; a cell of many rows is searched in parts, rows that ask are dealt
into slabs.  The driver sees a bounded sample of points, from which the cells are
made, and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cells import Tree, distances, greatest_distances, grown, least_distances
from tidemark.sources.tables import cut_lineage

#: Training rows of a cell, about, and cells at most; points from which cells are made.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 512, 4096, 20_000
#: Rows that miss 0, 1, ... coordinates are in cells of their own, up to this number.
APART = 3
#: Rows of a part of a cell, and rows that ask in a slab, about.
PART_ROWS, SLAB_ROWS = 8192, 2048
#: Rows to be filled whose distances are held at a time.
ROWS_AT_ONCE = 128
#: What rounding may do to a bound.
SLACK = 1 + 1e-9
WHOLE = ""


def matrix(points: pd.Series, width: int) -> np.ndarray:
    return np.stack(points.to_list()).astype(float) if len(points) else np.zeros((0, width))


def cells_from(donors: DataFrame, width: int) -> Tree:
    rows = donors.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    place = F.shiftrightunsigned(F.xxhash64("_key", "_point"), 1) / F.lit(float(1 << 63))
    points = np.array([r[0] for r in donors.filter(place < share).select("_point").limit(2 * SAMPLE_ROWS).collect()], float).reshape(-1, len(donors.first()["_point"]) if rows else width)
    return grown(points[:, :width], max(1, len(points) // max(1, min(MOST_CELLS, -(-rows // CELL_ROWS)))))


def holes_in(near: int) -> Column:
    return sum((F.isnan(F.col("_point")[k]).cast("int") for k in range(near)), F.lit(0))


def cell_table(placed: DataFrame, columns: int, near: int) -> DataFrame:
    """By set and cell: n, by column the least and greatest value and how many have one, and how many of the first `near` a row misses at most."""
    known = [F.when(~F.isnan(F.col("_point")[k]), F.col("_point")[k]) for k in range(columns)]
    arrays = {"low": F.min, "high": F.max, "known": F.count}
    return placed.groupBy("_set", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max(holes_in(near)).alias("missing"), *(F.array(*(f(x) for x in known)).alias(name) for name, f in arrays.items()))


class Aim:
    """Which cells a row with holes has to be sent to."""

    def __init__(self, near: int, filled: list[int], neighbours: int) -> None:
        self.near, self.filled, self.neighbours = near, filled, neighbours

    def sent(self, asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(cells):
            cells = cells.sort_values("_cell")
            numbers, count, missing = (cells[c].to_numpy() for c in ("_cell", "n", "missing"))
            low, high, known = (np.stack([np.array([np.nan if v is None else v for v in x], float) for x in cells[c]]) for c in ("low", "high", "known"))
            for row, point, kth in zip(asked["_row"], asked["_point"], asked["_kth"], strict=True):
                chosen = self.cells(np.asarray(point, float), low, high, known, count, missing, None if kth is None else dict(kth))
                out.append((np.full(len(chosen), row), numbers[chosen]))
        rows, chosen = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [])
        return pd.DataFrame({"_row": np.asarray(rows, np.int64), "_set": asked["_set"].iloc[0] if len(asked) else None, "_cell": np.asarray(chosen, np.int32)})

    def cells(self, point: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, count: np.ndarray, missing: np.ndarray, kth: dict[int, float] | None) -> np.ndarray:
        """The first cells to search; or, where the kth distances of these are given by column, all others that may hold nearer rows."""
        d = self.near
        box = low[:, :d], high[:, :d], known[:, :d]
        bounds = least_distances(point[:d], *box, count, missing)
        holes = [c for c in self.filled if np.isnan(point[c])]
        order = np.argsort(greatest_distances(point[:d], *box), kind="stable")
        order = order[np.isfinite(bounds[order])]
        if not len(order):
            return order
        enough = np.cumsum(known[order][:, holes], axis=0) >= self.neighbours
        until = np.where(enough.any(axis=0), enough.argmax(axis=0), len(order) - 1).max() + 1
        if kth is None:
            return order[:until]
        rest = order[until:]
        limits = np.array([kth.get(c, np.inf) for c in holes])
        return rest[((bounds[rest, None] <= limits * SLACK) & (known[rest][:, holes] > 0)).any(axis=1)]


def nearest_in(asked: pd.DataFrame, donors: pd.DataFrame, near: int, filled: list[int], neighbours: int) -> pd.DataFrame:
    """By row and column with a hole the nearest of these rows that have a value, equally near ones by their key."""
    out = []
    if len(asked) and len(donors):
        donors = donors.sort_values("_key", kind="stable")
        keys, known = donors["_key"].to_numpy(), matrix(donors["_point"], near)
        rows, points = asked["_row"].to_numpy(), matrix(asked["_point"], near)
        for start in range(0, len(points), ROWS_AT_ONCE):
            part = points[start : start + ROWS_AT_ONCE]
            far = distances(part[:, :near], known[:, :near])
            for c in filled:
                holes, have = np.flatnonzero(np.isnan(part[:, c])), np.flatnonzero(~np.isnan(known[:, c]))
                if not len(holes) or not len(have):
                    continue
                own = far[np.ix_(holes, have)]
                found = np.argsort(own, axis=1, kind="stable")[:, :neighbours]
                width, best = found.shape[1], np.take_along_axis(own, found, 1).ravel()
                at = have[found.ravel()]
                out.append(pd.DataFrame({"_row": np.repeat(rows[start + holes], width), "_column": c, "_far": best, "_key": keys[at], "_value": known[at, c]})[np.isfinite(best)])
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in ("_row", "_column", "_far", "_key", "_value")})


def fill_nearest(df: DataFrame, key: str, near: Sequence[str], filled: Sequence[str], neighbours: int = 5, train: DataFrame | None = None, group: str | None = None, by_key: bool = False) -> DataFrame:
    """`df` with the missing values (null or no number) of the columns `filled` replaced by the mean over the nearest training rows that have one; these columns become doubles.

    Distances go over the columns `near` that both rows have.  Training rows that share
    none don't count; where none is left, the value is the column's mean over training
    rows, or with `by_key` that of the rows of least keys.  With `group`, rows are
    filled from training rows of their own group, unless it is null or its training rows
    miss one of the columns altogether: then from all.
    """
    train = df if train is None else train
    columns = list(dict.fromkeys([*near, *filled]))
    d, holes = len(near), [columns.index(c) for c in filled]
    number = {c: F.col(f"`{c}`").cast("double") for c in columns}
    point = F.array(*(F.coalesce(x, F.lit(float("nan"))) for x in number.values())).alias("_point")

    def has(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x)

    every = train.select(F.col(key).alias("_key"), point, F.lit(WHOLE).alias("_set"))
    asked_set: Column = F.lit(WHOLE)
    asking = df
    if group:
        label = F.concat(F.lit("="), F.col(f"`{group}`").cast("string"))
        whole_columns = [F.count_if(has(x)) > 0 for x in number.values()]
        good = train.withColumn("_set", label).filter("_set IS NOT NULL").groupBy("_set").agg(*(c.alias(f"_c{k}") for k, c in enumerate(whole_columns)))
        good = cut_lineage(good.filter(" AND ".join(f"_c{k}" for k in range(len(columns)))).select("_set"))
        own = train.select(F.col(key).alias("_key"), point, label.alias("_set")).join(good, "_set").select("_key", "_point", "_set")
        every = own.unionByName(every)
        asking = df.withColumn("_label", label).join(good.withColumnRenamed("_set", "_good"), F.col("_label") == F.col("_good"), "left")
        asked_set = F.coalesce("_good", F.lit(WHOLE))
    asking = asking.withColumns({"_set": asked_set, "_point": point})
    open_ = F.exists(F.array(*(F.col("_point")[k] for k in holes)), lambda x: F.isnan(x))
    asked = cut_lineage(asking.filter(open_).select("_set", "_point").distinct()).withColumn("_row", F.monotonically_increasing_id())
    sets = asked.select("_set").distinct()
    every = every.join(sets, "_set", "left_semi")

    means = every.groupBy("_set").agg(F.array(*(F.avg(F.when(~F.isnan(F.col("_point")[k]), F.col("_point")[k])) for k in holes)).alias("_means"))
    same = Window.partitionBy("_set", "_point").orderBy("_key")
    donors = every.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= neighbours).drop("_n")
    tree = cells_from(donors, d)

    @F.pandas_udf("int")
    def cell(points: pd.Series) -> pd.Series:
        return pd.Series(tree.cells_of(matrix(points, d)[:, :d]), dtype="int32")

    placed = cut_lineage(donors.withColumn("_cell", cell("_point") * (APART + 1) + F.least(holes_in(d), F.lit(APART))))
    cells = cut_lineage(cell_table(placed, len(columns), d))
    slabs = max(1, -(-asked.count() // SLAB_ROWS))
    kind = df.schema[key].dataType.simpleString()
    found_as = f"_row long, _column int, _far double, _key {kind}, _value double"
    aim = Aim(d, holes, neighbours)
    best = Window.partitionBy("_row", "_column").orderBy("_far", "_key")

    def search(state: DataFrame) -> DataFrame:
        """The nearest of the cells that rows are sent to by what is known of their kth distances."""
        dealt = state.withColumn("_slab", F.pmod(F.xxhash64("_row"), F.lit(slabs)).cast("int"))
        everywhere = cells.withColumn("_slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
        sent = cut_lineage(dealt.groupBy("_set", "_slab").cogroup(everywhere.groupBy("_set", "_slab")).applyInPandas(lambda a, b: aim.sent(a, b), "_row long, _set string, _cell int"))
        plan = cells.join(sent.groupBy("_set", "_cell").agg(F.count(F.lit(1)).alias("_asked")), ["_set", "_cell"])
        plan = plan.select("_set", "_cell", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("_parts"), F.ceil(F.col("_asked") / SLAB_ROWS).cast("int").alias("_slabs"))
        where = ["_set", "_cell", "_part", "_slab"]
        rows = sent.join(plan, ["_set", "_cell"]).join(state.select("_row", "_point"), "_row").withColumns({"_part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)), "_slab": F.pmod(F.xxhash64("_row"), "_slabs").cast("int")})
        known = placed.join(plan, ["_set", "_cell"]).withColumns({"_part": F.pmod(F.xxhash64("_key", "_point"), "_parts").cast("int"), "_slab": F.explode(F.sequence(F.lit(0), F.col("_slabs") - 1))})
        pairs = rows.select(*where, "_row", "_point").groupBy(*where).cogroup(known.select(*where, "_key", "_point").groupBy(*where))
        return pairs.applyInPandas(lambda a, b: nearest_in(a, b, d, holes, neighbours), found_as)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= neighbours)

    first = cut_lineage(ranked(search(asked.withColumn("_kth", F.lit(None).cast("map<int,double>")))))
    kth = first.filter(F.col("_rank") == neighbours).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_column", "_far"))).alias("_kth"))
    state = asked.join(kth, "_row", "left").withColumn("_kth", F.coalesce("_kth", F.create_map().cast("map<int,double>")))
    near_rows = ranked(first.drop("_rank").unionByName(search(state)))

    lists = near_rows.groupBy("_row", "_column").agg(F.array_sort(F.collect_list(F.struct("_far", "_key", "_value"))).alias("_near"))  # `neighbours` at most
    if by_key:
        at = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col("_point")[k].alias("v")) for k in holes)))
        rest = every.select("_set", "_key", at.alias("x")).filter(~F.isnan("x.v")).select("_set", "_key", F.col("x.c").alias("_column"), F.col("x.v").alias("_value"))
        rest = rest.withColumn("_n", F.row_number().over(Window.partitionBy("_set", "_column").orderBy("_key"))).filter(F.col("_n") <= 2 * neighbours)
        rest = rest.groupBy("_set", "_column").agg(F.array_sort(F.collect_list(F.struct(F.lit(float("inf")).alias("_far"), "_key", "_value"))).alias("_rest"))
        wanted = asked.select("_row", "_set", F.explode(F.filter(F.array(*(F.when(F.isnan(F.col("_point")[k]), F.lit(k)) for k in holes)), lambda x: x.isNotNull())).alias("_column"))
        lists = wanted.join(lists, ["_row", "_column"], "left").join(rest, ["_set", "_column"], "left")
        found = F.coalesce("_near", F.filter("_rest", lambda _: F.lit(False)))
        others = F.filter("_rest", lambda r: ~F.exists(found, lambda x: x["_key"] == r["_key"]))
        lists = lists.withColumn("_near", F.slice(F.concat(found, others), 1, neighbours)).filter(F.size("_near") > 0)
    averages = lists.select("_row", "_column", (F.aggregate("_near", F.lit(0.0), lambda a, x: a + x["_value"]) / F.size("_near")).alias("_mean"))
    by_row = averages.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_column", "_mean"))).alias("_found"))
    answers = asked.join(by_row, "_row", "left").join(means, "_set", "left").select("_set", "_point", "_found", "_means")

    values = {}
    for place, (c, k) in enumerate(zip(filled, holes, strict=True)):
        fallback = [] if by_key else [F.col("_means")[place]]
        values[c] = F.coalesce(F.when(has(number[c]), number[c]), F.try_element_at("_found", F.lit(k)), *fallback).alias(c)
    out = [values.get(c, F.col(f"`{c}`")) for c in df.columns]
    whole = asking.filter(~open_).withColumns({"_found": F.lit(None).cast("map<int,double>"), "_means": F.lit(None).cast("array<double>")})
    return whole.select(*out).unionByName(asking.filter(open_).join(answers, ["_set", "_point"]).select(*out))


def impute(df: DataFrame, key: str, features: Sequence[str], neighbours: int = 5, train: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """All `features` filled, by distances over all of them."""
    return fill_nearest(df, key, features, features, neighbours, train, group)


def impute_nearest(df: DataFrame, key: str, features: Sequence[str], value: str, neighbours: int = 5, train: DataFrame | None = None) -> DataFrame:
    """`df` with missing `value`s filled by distances over `features`; training rows that share none of those are the farthest."""
    return fill_nearest(df, key, features, [value], neighbours, train, by_key=True)
