"""Hard negatives by exact search in buckets of norms.

Vectors become integers, are put in order of their norms, longest first, and cut
into shelves (partitions of that order) and these into buckets.  By the inequality
of Cauchy and Schwarz no row of a bucket scores above the anchor's norm times the
bucket's greatest, so a bucket is left out where that product is below the least
score asked for: a window's lower limit, or the kth score found so far.  The first
shelf is searched for all anchors; what it yields raises the limits, by which the
further shelves that an anchor is sent to are chosen.  Inside a shelf the kth score
rises from bucket to bucket.

Anchors meet shelves in tiles of bounded bytes: an anchor is sent to the shelves it
needs, a shelf to each slab of anchors.  Every tile gives the best few of each
anchor and window; a ranked window keeps the best of all tiles.  The driver sees
counts and the greatest norms of 4096 runs of shelves at most.

Defined cases: a row without vec_id, label or vector, or with a component that is
null or isn't finite, also after scaling, takes no part; of rows that share a
vec_id, that of the least label, then the least vector, counts; vectors of different lengths are
filled up with zeros; ties go to the smaller vec_id; scores beyond 64 bits count as
the nearest number of 64 bits.  No rows give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed, parallelism, small_batches
from .worker import begin

#: Bytes of vectors, as doubles, in a shelf or slab, about; rows of either at most, about.
TILE_BYTES, TILE_ROWS = 32 << 20, 1 << 16
#: Rows of a bucket, a power of two; anchors that are scored against it at a time; values they make at most.
BUCKET, TOGETHER = 4096, 256
#: Rows for which another task is worth while.
FEW = 1024
#: Runs of shelves whose greatest norms the driver sees.
RUNS = 4096
#: Scores below this can be put in order together with a place in a bucket.
NARROW = float(1 << 50)
NONE, ALL = -(1 << 63), (1 << 63) - 1
#: What rounding may do to a norm, as a factor.
SLACK = 1 + 1e-9
FOUND_NAMES = ("anchor_id", "window", "vec_id", "score")
FOUND = "anchor_id long, window int, vec_id long, score long"


def scaled_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, label (both long), vec (floor of scale times each component, as doubles) and norm of the rows that take part."""
    big, finite = float(1 << 53), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: finite(scale * x.cast("double")))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").filter(usable)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))

    def whole(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < big, F.floor(y).cast("double")).otherwise(y)

    vectors = one.select("vec_id", "row.label", F.transform("row.embedding", whole).alias("vec"))
    return vectors.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)) * SLACK)


def matrix(vectors: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """A row for each list of numbers, filled up with zeros."""
    column = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def bucketed(vectors: DataFrame, shelves: int) -> DataFrame:
    """Buckets of rows by falling norm: shelf, top (the greatest norm), count, width, ids, labels and data (a matrix, of floats where they hold the numbers exactly)."""

    def bucket(shelf: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("vec_id")  # so a smaller place is a smaller id
        data = matrix(rows.column("vec"))
        data = data.astype(np.float32) if np.abs(data).max(initial=0) < 1 << 24 else data
        values = [shelf, max(rows.column("norm").to_pylist()), *data.shape, rows.column("vec_id").to_numpy().tobytes(), rows.column("label").to_numpy().tobytes(), data.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["shelf", "top", "count", "width", "ids", "labels", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("hard_negatives")
        shelf, waiting, rows, size = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                part = batch.slice(at, FEW)
                if rows and (rows + part.num_rows > BUCKET or size + part.nbytes > TILE_BYTES // 4):
                    yield bucket(shelf, pa.Table.from_batches(waiting))
                    waiting, rows, size = [], 0, 0
                waiting.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
        if rows:
            yield bucket(shelf, pa.Table.from_batches(waiting))

    falling = (F.col("norm").desc(), F.col("vec_id"))
    ordered = small_batches(vectors).repartitionByRange(shelves, *falling).sortWithinPartitions(*falling)
    return checkpointed(ordered.mapInArrow(packed, "shelf int, top double, count int, width int, ids binary, labels binary, data binary"))


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """The exact inner products of rows, which `most` bounds, as 64-bit numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))
    if most < 4 * NARROW:  # no partial sum is rounded
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    to_int = np.frompyfunc(int, 1, 1)
    return np.clip(to_int(a).dot(to_int(b).T), NONE + 1, ALL).astype(np.int64).reshape(len(a), len(b))


def leading(scores: np.ndarray, fits: np.ndarray, k: int, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """By row the scores and places of the k best that fit, a smaller place first among equals; NONE where there are fewer."""
    places = np.arange(scores.shape[1])
    if narrow:
        keys = np.where(fits, scores * BUCKET + (BUCKET - 1 - places), NONE)
        top = np.argpartition(keys, -k, axis=1)[:, -k:] if keys.shape[1] > k else np.broadcast_to(places, keys.shape)
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), axis=1, kind="stable"), 1)
    else:
        top = np.lexsort((np.broadcast_to(places, scores.shape), -np.where(fits, scores, NONE + 1), ~fits), axis=1)[:, :k]
    return np.where(np.take_along_axis(fits, top, 1), np.take_along_axis(scores, top, 1), NONE), top


class Windows:
    """The k best so far of some anchors, for each of their windows [low, high] of scores."""

    def __init__(self, lows: list[list[int]], highs: list[list[int]], k: int) -> None:
        count = max(map(len, lows))
        self.low = np.array([x + [ALL] * (count - len(x)) for x in lows], np.int64).reshape(-1, count)
        self.high = np.array([x + [NONE] * (count - len(x)) for x in highs], np.int64).reshape(-1, count)
        self.scores = np.full((*self.low.shape, k), NONE, np.int64)
        self.ids = np.full((*self.low.shape, k), ALL, np.int64)
        self.k = k

    def open_to(self, bounds: np.ndarray) -> np.ndarray:
        """Which windows a score of up to `bounds` may enter, by anchor and window.  A score that equals the kth may have a smaller id."""
        least = np.maximum(self.low, self.scores[:, :, -1]).astype(np.float64)
        return (self.low <= self.high) & ~(bounds[:, None] * SLACK < least)

    def add(self, rows: np.ndarray, window: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.hstack((self.scores[rows, window], scores)), np.hstack((self.ids[rows, window], ids))
        order = np.lexsort((ids, -(scores + 1), scores == NONE), axis=1)[:, : self.k]
        self.scores[rows, window], self.ids[rows, window] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def found(self) -> tuple[np.ndarray, ...]:
        """Anchor (by place), window, id and score of all."""
        at = np.nonzero(self.scores != NONE)
        return at[0], at[1], self.ids[at], self.scores[at]


def search(anchors: pa.Table, shelf: pa.Table, same: bool, k: int) -> pa.Table:
    """The best k of a shelf by anchor and window, among the rows of the anchor's label or of all others, itself left out."""
    begin("hard_negatives")
    out = []
    buckets = sorted(shelf.to_pylist(), key=lambda b: -b["top"])
    for at in range(0, anchors.num_rows if buckets else 0, TOGETHER):
        part = anchors.slice(at, TOGETHER)
        own, norms, own_ids, own_labels = matrix(part.column("vec")), *(part.column(c).to_numpy() for c in ("norm", "vec_id", "label"))
        windows = Windows(part.column("lows").to_pylist(), part.column("highs").to_pylist(), k)
        for bucket in buckets:
            open_ = windows.open_to(norms * bucket["top"])
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                continue
            ids, labels = (np.frombuffer(bucket[c], np.int64) for c in ("ids", "labels"))
            shape = bucket["count"], bucket["width"]
            data = np.frombuffer(bucket["data"], np.float32 if len(bucket["data"]) == 4 * shape[0] * shape[1] else np.float64).reshape(shape)
            most = float(norms[rows].max() * bucket["top"])
            scores = products(own[rows], data, most)
            allowed = ((own_labels[rows, None] == labels) == same) & (own_ids[rows, None] != ids)
            for window in range(open_.shape[1]):
                inside = open_[rows, window]
                if inside.any():
                    chosen = rows[inside]
                    fits = allowed[inside] & (scores[inside] >= windows.low[chosen, window][:, None]) & (scores[inside] <= windows.high[chosen, window][:, None])
                    best, places = leading(scores[inside], fits, k, most < NARROW)
                    windows.add(chosen, window, best, np.where(best == NONE, ALL, ids[places]))
        row, window, ids, scores = windows.found()
        out.append((own_ids[row], window.astype(np.int32), ids, scores))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
    return pa.table(dict(zip(FOUND_NAMES, columns, strict=True)))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """rank (from 1) among those of an anchor and window, up to k."""
    w = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(anchors: DataFrame, buckets: DataFrame, tops: list[float], run: int, shelves: int, slabs: int, same: bool, k: int) -> DataFrame:
    """anchor_id, window, vec_id, score and rank of the k best in each window of `anchors` (vec_id, label, vec, norm, lows, highs)."""
    falling = -np.array(tops)

    @F.pandas_udf("int")
    def shelves_in_reach(need: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.searchsorted(falling, -need.fillna(0.0), side="right") * run, shelves)).astype("int32")

    def tiles(state: DataFrame, first: int, last: Column) -> DataFrame:
        sent = state.withColumns({"shelf": F.explode(F.sequence(F.lit(first), last)), "slab": F.pmod(F.xxhash64("vec_id"), F.lit(slabs)).cast("int")})
        shelved = buckets.filter(F.col("shelf") >= first) if first else buckets.filter("shelf = 0")
        dealt = shelved.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))))
        return sent.groupBy("shelf", "slab").cogroup(dealt.groupBy("shelf", "slab")).applyInArrow(lambda a, b: search(a, b, same, k), FOUND)

    found = best_of(tiles(anchors, 0, F.lit(0)), k)
    if shelves == 1:
        return checkpointed(found)
    found = checkpointed(found)
    kth = found.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # windows are few
    raised = anchors.join(kth, anchors["vec_id"] == kth["anchor_id"], "left")
    raised = raised.withColumn("lows", F.transform("lows", lambda low, i: F.greatest(low, F.try_element_at("kth", i)))).drop("anchor_id", "kth")
    asked = F.array_min(F.transform("lows", lambda low, i: F.when(low <= F.get("highs", i), low.cast("double"))))
    reach = raised.withColumn("last", shelves_in_reach(F.when(asked > 0, asked / F.col("norm") / SLACK)) - 1).filter("last >= 1")
    return checkpointed(best_of(found.select(*FOUND_NAMES).unionByName(tiles(reach, 1, F.col("last")).select(*FOUND_NAMES)), k))


def hard_negatives(embeddings: DataFrame, is_anchor: Column, scale: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on vec_id and label.  An anchor's positives are its best
    rows of the same label; for each of them, the best rows of other labels follow whose
    score is `low` to `high` hundredths of the positive's.
    """
    vectors = checkpointed(scaled_vectors(embeddings, scale))
    own = vectors.filter(is_anchor)
    rows, numbers = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    asking, asked_numbers = own.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    tiles = lambda n, values: max(1, -(-n // TILE_ROWS), -(-8 * values // TILE_BYTES))
    slabs = tiles(asking, asked_numbers)
    buckets = bucketed(vectors, max(tiles(rows, numbers), min(2 * parallelism(embeddings.sparkSession), -(-rows // FEW))))
    shelves = (buckets.agg(F.max("shelf")).first()[0] or 0) + 1
    run = -(-shelves // RUNS)
    by_run = {row[0]: row[1] for row in buckets.groupBy(F.floor(F.col("shelf") / run)).agg(F.max("top")).collect()}
    tops, greatest = [], float("inf")
    for k in range(-(-shelves // run)):
        greatest = min(greatest, by_run.get(k, greatest))
        tops.append(greatest)

    everything = own.withColumns({"lows": F.array(F.lit(NONE + 1)), "highs": F.array(F.lit(ALL))})
    best = nearest(everything, buckets, tops, run, shelves, slabs, True, positives)
    best = best.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    def hundredths(of: int, rounded: Callable[[Column], Column]) -> Column:
        exact = F.col("positive_score").cast("decimal(20,0)") * F.lit(of).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)")
        return F.least(F.greatest(rounded(exact).cast("decimal(38,0)"), F.lit(NONE + 1).cast("decimal(38,0)")), F.lit(ALL).cast("decimal(38,0)")).cast("long")

    bounds = best.withColumns({"least": hundredths(low, F.ceil), "most": hundredths(high, F.floor)})
    windows = bounds.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "least", "most"))).alias("w"))  # `positives` of them at most
    asked = own.join(windows, own["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "vec", "norm", F.col("w.least").alias("lows"), F.col("w.most").alias("highs"))
    found = nearest(asked, buckets, tops, run, shelves, slabs, False, negatives)
    named = found.withColumn("place", F.col("window") + 1).join(best, ["anchor_id", "place"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
