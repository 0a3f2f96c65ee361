"""Similarity join of documents on their word shingles, by signature trees.

1. Chunks ask how widely each of their shingles occurs (`exchange`).  A document
   can be linked only if enough of its shingles, `part` of `whole`, occur elsewhere
   too: the others are done.
2. Documents with equal sets are one set.  Its rarest shingles, as many as a linked
   set can't miss all of, name the sets with which it may be linked.  Sets that are
   connected through such shingles are a neighbourhood.
3. In each neighbourhood the sets are put into signature trees that are walked
   together (`signature_tree`).  A neighbourhood of more than TILE sets is cut into
   tiles of about so many by a hash, and each pair of tiles is a task of its own.
4. The links found make up the components.  Hashes only lead to links: before one
   counts, the shingles of both texts themselves are compared.

Of equal texts, and of sets that are linked already through others, not every
pair is compared, but no link between components is missed; should hashes have
lied about a link, all pairs that they let pass are compared again.

Defined cases: a null or wordless text has an empty set, linked with nothing; rows
with one id are one node; texts of any length count whole; extra columns are not
read; no rows give none.  A null id is a node that comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import NULL_ID, Chunk, answer, ask, buckets_of, by_bucket, pack_chunks, text_bytes
from .shingles import shingle_sets, shingles_of
from .signature_tree import Members
from .suffix_dedup import bucket_of
from .tables import checkpointed, joined_on_hot
from .worker import begin

TILE = 4096
#: Texts that are sent to every executor at most, since very many links have them.
HOT_TEXTS = 64
#: Ids that are sent to every executor at most; more of them are joined by a shuffle.
SENT_IDS = 500_000


def distinct(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a chunk, sorted; whether several documents have each; where each bucket begins."""
    hashes, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
    return hashes, counts > 1, np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))


def carried_bytes(text_bytes: int, buckets: int) -> int:
    """Bytes of a hash that a question carries, their highest bit aside: eight times the places that a bucket's hashes take.  Hashes that fall together seem more common than they are, which costs time only."""
    return max(3, -(-((text_bytes // (6 * buckets) * 8).bit_length() + 1) // 8))


def carried(hashes: np.ndarray, several: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` bytes for each hash: its low bits, and whether several documents of the chunk have it."""
    top = np.uint64(8 * width - 1)
    low = hashes & ((np.uint64(1) << top) - np.uint64(1))
    return (low | several.astype(np.uint64) << top).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def spread(payloads: list[bytes], width: int) -> list[bytes]:
    """By hash 0 if it occurs once, else how many chunks have it, in powers of two."""
    sizes = [len(p) // width for p in payloads]
    asked = np.zeros((sum(sizes), 8), np.uint8)
    asked[:, :width] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width)
    asked = asked.view("<u8").ravel()
    top = np.uint64(8 * width - 1)
    low = asked & ((np.uint64(1) << top) - np.uint64(1))
    order = np.argsort(low, kind="stable")
    ordered = low[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(1 + (asked[order] >> top).astype(np.int64), heads)
    level = np.empty(len(asked), np.uint8)
    level[order] = np.repeat(np.where(total > 1, np.frexp(total.astype(float))[1], 0).astype(np.uint8), np.diff(np.append(heads, len(ordered))))
    return [x.tobytes() for x in np.split(level, np.cumsum(sizes)[:-1])]


def least_overlap(n: int, part: int, whole: int) -> int:
    """Shingles that a set of n shares with any linked one."""
    return -(-part * n // whole)


def shingle_rows(chunks: DataFrame, buckets: int, part: int, whole: int) -> DataFrame:
    """By document: doc_id, n_shingles, and for those that may be linked `set` (16 bytes that name the set), in one row of a chunk for each set also its shared shingles, rarest first, how many of them may not all be missing, and the text, compressed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                chunk = Chunk(row)
                sets = shingle_sets(chunk)
                hashes, _, edges = distinct(sets, buckets)
                level = np.zeros(len(hashes), np.uint8)
                for bucket, said in by_bucket(row["spread"]).items():
                    level[edges[bucket] : edges[bucket + 1]] = np.frombuffer(said, np.uint8)
                out, given = [], set()
                for doc_id, have, begins, size in zip(chunk.ids.tolist(), sets, chunk.begins.tolist(), chunk.sizes.tolist(), strict=True):
                    of = level[np.searchsorted(hashes, have)]
                    shared, needed = int((of > 0).sum()), least_overlap(len(have), part, whole)
                    name = tokens = first = text = None
                    if len(have) and shared >= needed:
                        name = hashlib.blake2b(have.tobytes(), digest_size=16).digest()
                        if name not in given:
                            given.add(name)
                            order = np.lexsort((have, of))[len(have) - shared :]
                            tokens, first = have[order].tobytes(), shared - needed + 1
                            text = squeezed(chunk.data[begins : begins + size].tobytes())
                    out.append((doc_id, len(have), name, tokens, first, text))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_shingles", "set", "tokens", "first", "text"])

    return chunks.mapInArrow(rows, "doc_id long, n_shingles long, set binary, tokens binary, first int, text binary")


def prefix_shingles(sets: DataFrame) -> DataFrame:
    """(shingle, set) for each set's rarest ones."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        for batch in batches:
            firsts = batch.column(2).to_pylist()
            shingles = [np.frombuffer(t, np.int64, n) for t, n in zip(batch.column(1).to_pylist(), firsts, strict=True)]
            names = batch.column(0).take(pa.array(np.repeat(np.arange(len(firsts)), firsts)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingles, np.zeros(0, np.int64)])), names], names=["shingle", "set"])

    return sets.select("set", "tokens", "first").mapInArrow(pairs, "shingle long, set binary")


def tile_pairs(sets: DataFrame, neighbourhoods: DataFrame, tile: int) -> DataFrame:
    """The sets of every neighbourhood, dealt to its pairs of tiles."""
    counted = neighbourhoods.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles"), F.count("*").alias("_n"))
    placed = joined_on_hot(neighbourhoods, counted, "root", "_n", neighbourhoods.count())
    tiles = placed.select(F.col("node").alias("set"), "root", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int").alias("tile"), "_tiles")
    others = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    dealt = sets.join(tiles, "set").select("set", "n_shingles", "tokens", "root", "tile", others)
    return dealt.withColumn("low", F.least("tile", "_other")).withColumn("high", F.greatest("tile", "_other")).drop("_other")


def tree_links(dealt: DataFrame, part: int, whole: int, thorough: bool = False) -> DataFrame:
    """Links (a, b) that connect what is connected in each pair of tiles; thorough: all links."""

    def walked(table: pa.Table) -> pa.Table:
        begin("exchange")
        names = table.column("set").to_pylist()
        tokens = [np.sort(np.frombuffer(t, np.uint64)) for t in table.column("tokens").to_pylist()]
        members = Members(tokens, table.column("n_shingles").to_pylist(), part, whole, thorough)
        tiles = table.column("tile").to_pylist()
        trees = [members.tree([k for k, t in enumerate(tiles) if t == tile]) for tile in sorted(set(tiles))]
        for k, x in enumerate(trees):
            for y in trees[k:]:
                members.walk(x, y)
        a, b = zip(*members.links, strict=True) if members.links else ((), ())
        return pa.table({"a": pa.array([names[k] for k in a], pa.binary()), "b": pa.array([names[k] for k in b], pa.binary())})

    return dealt.groupBy("root", "low", "high").applyInArrow(walked, "a binary, b binary")


def squeezed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def compared(links: DataFrame, given: DataFrame, part: int, whole: int) -> DataFrame:
    """Links with `same`: whether the shingles of the texts themselves are as similar.  given: set and text, one row at least for each set."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        last = (b"", set())  # several links of one set stand together
        for batch in batches:
            same = []
            for name, one, other in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if last[0] != name:
                    last = (name, shingles_of(unsqueezed(one)))
                x, y = last[1], shingles_of(unsqueezed(other))
                overlap = len(x & y)
                same.append(whole * overlap >= part * (len(x) + len(y) - overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"])

    count = links.count()
    sides = [F.struct(F.col(name).alias("set"), F.lit(int(name == "a")).alias("x"), F.lit(int(name == "b")).alias("y")) for name in ("a", "b")]
    ends = links.select(F.explode(F.array(*sides)).alias("e"))
    ends = ends.groupBy("e.set").agg(F.sum("e.x").alias("_x"), F.sum("e.y").alias("_y"))
    texts = given.join(ends, "set").dropDuplicates(["set"])
    rows = joined_on_hot(links, texts.select(F.col("set").alias("b"), F.col("text").alias("_b"), "_y"), "b", "_y", count, HOT_TEXTS)
    rows = joined_on_hot(rows, texts.select(F.col("set").alias("a"), F.col("text").alias("_a"), "_x"), "a", "_x", count, HOT_TEXTS)
    return rows.select("a", "b", "_a", "_b").mapInArrow(judged, "a binary, b binary, same boolean")


def similar_components(documents: DataFrame, part: int = 80, whole: int = 100, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every document."""
    size = text_bytes(documents)
    buckets = buckets_of(documents, size)
    width = carried_bytes(size, buckets)
    chunks = pack_chunks(documents)

    def question(row: dict) -> list[tuple[int, bytes]]:
        hashes, several, edges = distinct(shingle_sets(Chunk(row)), buckets)
        asked = carried(hashes, several, width)
        return [(b, asked[edges[b] : edges[b + 1]].tobytes()) for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]

    known = chunks.join(answer(ask(chunks, question), lambda _, payloads: spread(payloads, width), "spread"), "chunk", "left")
    rows = checkpointed(shingle_rows(known, buckets, part, whole))
    candidates = rows.filter("set IS NOT NULL").select("doc_id", "n_shingles", "set")
    given = rows.filter("tokens IS NOT NULL")
    pairs = checkpointed(prefix_shingles(given).distinct())
    centres = pairs.groupBy("shingle").agg(F.min("set").alias("a"), F.max("set").alias("_most"), F.count("*").alias("_n")).filter("a < _most").drop("_most")
    near = joined_on_hot(pairs, centres, "shingle", "_n", pairs.count()).select("a", F.col("set").alias("b")).filter("a < b").distinct()
    # one row for each set, whichever chunk gave it; shingles by rarity are the same in all of them
    sets = given.select("set", "n_shingles", "tokens").dropDuplicates(["set"])
    dealt = tile_pairs(sets, components(near), tile)
    links = checkpointed(tree_links(dealt, part, whole))
    texts = given.select("set", "text")
    judged = checkpointed(compared(links, texts, part, whole))
    if not judged.filter("NOT same").isEmpty():
        links = checkpointed(tree_links(dealt, part, whole, thorough=True))
        judged = checkpointed(compared(links, texts, part, whole))
    linked = components(judged.filter("same").select("a", "b"))
    # the least document of every set, then of every component of sets
    firsts = candidates.groupBy("set").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n"))
    rooted = firsts.join(linked.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_sets"))
    count = candidates.count()
    named = joined_on_hot(rooted, least, "root", "_sets", count).select("set", "component_id", "_n")
    alone = rows.filter("set IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = joined_on_hot(candidates, named, "set", "_n", count).select("doc_id", "n_shingles", "component_id").union(alone)
    return out.select(*(F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns))


def one_of_each(documents: DataFrame, part: int = 80, whole: int = 100) -> DataFrame:
    """The documents without those that links connect to one of smaller id, all their columns.  Rows with one id stay or go together; rows without an id stay."""
    found = checkpointed(similar_components(documents, part, whole))
    gone = found.filter("doc_id IS NOT NULL AND NOT component_id <=> doc_id").select("doc_id").distinct()
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)  # SENT_IDS numbers at most
    return documents.join(gone, documents["doc_id"] == gone["doc_id"], "left_anti")
