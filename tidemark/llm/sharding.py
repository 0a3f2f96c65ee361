"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**16 cells.  Each shard owns several virtual nodes, each in a cell
of its own.  A key falls into the cell that its hash names and belongs to the
first virtual node at or after it, clockwise.  A shard holds no more than its
capacity: keys that meet a full shard go on clockwise.  Capacities are the floor
or the ceiling of rows / shards and add up to the number of rows, so that row
counts differ by one at most.

Only counts by cell reach the driver (2**16 numbers whatever the input holds);
there the ring is walked once, which yields for each run of ranks in a cell its
shard and the first slot.  Rows find theirs by their rank in the cell.

Defined cases: a null key hashes like any other value; equal rows are told
apart by their order within the cell and get slots of their own; no rows give no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 1 << 16


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, by cell.  A node whose cell is taken moves to the next free one, so that adding a shard leaves earlier nodes in place."""
    taken: dict[int, int] = {}
    for node in range(virtual_nodes):
        for shard in range(shards):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=2).digest(), "big")
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], shards: int, virtual_nodes: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) that place every counted key."""
    nodes = ring(shards, virtual_nodes)
    cells, room = [cell for cell, _ in nodes], capacities(sum(counts.values()), shards)
    following = list(range(1, len(nodes))) + [0]  # the next node that may have room; shortened as shards fill
    slots, runs = [0] * shards, []

    def open_node(at: int) -> int:
        path = []
        while room[nodes[at][1]] == 0:
            path.append(at)
            at = following[at]
        for passed in path:
            following[passed] = at
        return at

    for cell in sorted(counts):
        first, at = 0, bisect.bisect_left(cells, cell) % len(nodes)
        while first < counts[cell]:
            at = open_node(at)
            shard = nodes[at][1]
            taken = min(room[shard], counts[cell] - first)
            runs.append((cell, first, first + taken, shard, slots[shard]))
            room[shard] -= taken
            slots[shard] += taken
            first += taken
    return runs


def bounded_shards(df: DataFrame, key: Column, order: list[Column], shards: int, virtual_nodes: int = 64) -> DataFrame:
    """`df` with `shard` and `slot` (gapless from 0 in each shard).  `order` makes the order of rows with one hash total."""
    if shards < 1 or not 1 <= shards * virtual_nodes <= CELLS // 2:
        raise ValueError("the ring needs a shard at least, and holds no more than half as many nodes as cells")
    spark: SparkSession = df.sparkSession
    hashed = F.xxhash64(key)
    cell = F.shiftrightunsigned(hashed, 48).cast("int")
    counts = {row[0]: row[1] for row in df.groupBy(cell.alias("cell")).count().collect()}  # CELLS rows at most
    runs = walk(counts, shards, virtual_nodes)
    placed = spark.createDataFrame(runs, "run_cell int, run_first long, run_end long, shard int, run_slot long")
    ranked = df.withColumns({"_cell": cell, "_hash": hashed})
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", *order)).cast("long") - 1)
    inside = (F.col("_cell") == F.col("run_cell")) & (F.col("_rank") >= F.col("run_first")) & (F.col("_rank") < F.col("run_end"))
    # runs: one for each cell and one more for each time that a shard fills up, so 2**16 + shards rows at most
    return ranked.join(F.broadcast(placed), inside).withColumn("slot", F.col("run_slot") + F.col("_rank") - F.col("run_first")).drop("_cell", "_hash", "_rank", "run_cell", "run_first", "run_end", "run_slot")


def shard_documents(documents: DataFrame, shards: int = 24, virtual_nodes: int = 64) -> DataFrame:
    """Shard, slot and digest of every document, under the law of equal row counts."""
    data = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    rows = documents.select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    placed = bounded_shards(rows, F.col("doc_id"), [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards, virtual_nodes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
