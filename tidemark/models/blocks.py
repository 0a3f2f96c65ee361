"""Rows packed into matrices, and sums over them: what the fitting of networks and boosted trees shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import cut_lineage

#: Rows of a block at most; tasks' sums that the driver adds up itself.
BLOCK_ROWS, TOGETHER = 1024, 16
PACKED = "block long, batch int, rows int, x binary, y binary, w binary, margin binary"


def packed(df: DataFrame, features: Sequence[str], label: str, weight: Column, batches: int = 1, seed: int = 0) -> DataFrame:
    """Blocks of rows: x (a matrix of doubles), y, w and margin (zeros).  A row's batch goes by its values, so it is the same wherever the row stands."""
    x = F.array(*(F.col(f"`{c}`").cast("double") for c in features))
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"), F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(batches)).cast("int").alias("batch"))

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        task, number = TaskContext.get().partitionId() << 32, 0

        def block(batch: int, values: np.ndarray) -> pa.RecordBatch:
            row = [task + number, batch, len(values), values[:, :-2].tobytes(), values[:, -2].tobytes(), values[:, -1].tobytes(), np.zeros(len(values)).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4], strict=True)], names=["block", "batch", "rows", "x", "y", "w", "margin"])

        for part in parts:
            if not part.num_rows:
                continue
            values = np.column_stack([part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)])
            batch = part.column(3).to_numpy()
            for b in np.unique(batch).tolist():
                waiting.setdefault(b, []).append(values[batch == b])
                while sum(map(len, waiting[b])) >= BLOCK_ROWS:
                    rows_ = np.concatenate(waiting[b])
                    yield block(b, rows_[:BLOCK_ROWS])
                    number += 1
                    waiting[b] = [rows_[BLOCK_ROWS:]]
        for b, rest in waiting.items():
            if sum(map(len, rest)):
                yield block(b, np.concatenate(rest))
                number += 1

    return cut_lineage(rows.mapInArrow(blocks, PACKED))


class Block:
    def __init__(self, row: dict) -> None:
        self.number, self.rows = row["block"], row["rows"]
        self.x = np.frombuffer(row["x"], float).reshape(self.rows, -1)
        self.y, self.w, self.margin = (np.frombuffer(row[c], float) for c in ("y", "w", "margin"))


def summed(blocks: DataFrame, value: Callable[[Block], np.ndarray], size: int) -> np.ndarray:
    """The sum of a vector over all blocks: in each task first, then over groups of tasks, then on the driver."""
    tasks = blocks.rdd.getNumPartitions()
    lanes = max(1, round(tasks**0.5))

    def by_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(size), False
        for part in parts:
            for row in part.to_pylist():
                total += value(Block(row))
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % lanes], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lane", "total"])

    def by_lane(group: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x, float) for x in group.column("total").to_pylist()), np.zeros(size))
        return pa.table({"lane": group.column("lane").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.mapInArrow(by_task, "lane int, total binary")
    if tasks > TOGETHER:
        sums = sums.groupBy("lane").applyInArrow(by_lane, "lane int, total binary")
    return sum((np.frombuffer(r.total, float) for r in sorted(sums.collect(), key=lambda r: (r.lane, bytes(r.total)))), np.zeros(size))
