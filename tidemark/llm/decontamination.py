"""Benchmark decontamination by an FM-index for each training shard.

A shard is a bounded run of rows of one scan partition.  Its words become symbols:
a word that no benchmark phrase has can't be part of an occurrence, so all such
words are one breaking symbol, and stretches between breaks that are shorter than
the shortest phrase are left out.  The FM-index of the rest is searched backwards
for all phrases, occurrences are located by sampled suffix positions, and their
spans are merged.  Documents aren't shuffled.

Phrases are the distinct windows of 13 words of an item, or the whole item if it is
shorter.  They go to the workers in blocks of bounded size; a shard is searched for
one block after the other.

Defined cases: a null or wordless text has no words and no hits; a null or wordless
item has no phrase; an item without an id hits words, but has no name by which it
could be counted or listed; texts are searched whole, and occurrences never cross
documents; items with equal phrases all count; equal rows give equal rows; an
empty benchmark hits nothing; other columns are carried only if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .tables import small_batches, spare_name
from .worker import begin

WINDOW = 13
#: Bytes of item texts in a block of phrases, and of documents in a shard, about.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 12 << 20

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text.lower() if text.isascii() else text.translate(CAPITALS))


class Phrases:
    """The distinct phrases of some items, as symbols from 2, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.symbols: dict[str, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.items = [item for item, _ in items]
        for k, (_, text) in enumerate(items):
            numbers = [self.symbols.setdefault(word, len(self.symbols) + 2) for word in words_of(text)]
            width = min(WINDOW, len(numbers))
            for phrase in {tuple(numbers[i : i + width]) for i in range(len(numbers) - width + 1)} if width else ():
                owners.setdefault(phrase, []).append(k)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.table = np.zeros((len(owners), WINDOW), np.int64)
        for row, phrase in enumerate(owners):
            self.table[row, : len(phrase)] = phrase
        self.owners = list(owners.values())
        self.shortest = int(self.lengths.min()) if owners else 0


def occurrences(shard: list[list[str]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all phrases in a shard: document, first word, phrase."""
    none = np.zeros(0, np.int64)
    sizes = [len(words) for words in shard]
    if not phrases.owners or not sum(sizes):
        return none, none, none
    get = phrases.symbols.get
    known = np.concatenate([np.fromiter((get(w, 1) for w in words), np.int32, len(words)) for words in shard])
    document = np.repeat(np.arange(len(shard)), sizes)
    first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)  # the place of the document's first word
    inside = known > 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (document[1:] != document[:-1])
    stretch = np.cumsum(begins)  # numbered from 1 where inside
    long_enough = np.bincount(stretch[inside], minlength=stretch[-1] + 1) >= phrases.shortest
    keep = np.flatnonzero(inside & long_enough[stretch])
    if not len(keep):
        return none, none, none
    # a break before every stretch
    breaks = np.flatnonzero(begins[keep])
    text = np.insert(known[keep].astype(np.int64), breaks, 1)
    place = np.insert(keep, breaks, -1)
    index = FMIndex(text, len(phrases.symbols) + 1)
    low, high = index.ranges(phrases.table, phrases.lengths)
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    found = place[index.locate(rows)]
    return document[found], found - first[found], which


def searched(shard: list[list[str]], blocks: Iterator[Phrases]) -> tuple[list[int], list[list[list[int]]], list[list[str]]]:
    """By document of a shard: hit words, merged spans of words, and items, sorted."""
    marks = [np.zeros(len(words) + 1, np.int32) for words in shard]
    items: list[set[str]] = [set() for _ in shard]
    for phrases in blocks:
        document, begin, which = occurrences(shard, phrases)
        by_document = np.argsort(document, kind="stable")
        document, begin, which = document[by_document], begin[by_document], which[by_document]
        edges = np.flatnonzero(np.diff(document, prepend=-1))
        for at, end in zip(edges, [*edges[1:], len(document)], strict=False):
            d, mine = document[at], which[at:end]
            np.add.at(marks[d], begin[at:end], 1)
            np.add.at(marks[d], begin[at:end] + phrases.lengths[mine], -1)
            items[d].update(phrases.items[k] for row in np.unique(mine) for k in phrases.owners[row] if phrases.items[k] is not None)
    hits, spans = [], []
    for mark in marks:
        edges = np.flatnonzero(np.diff((np.cumsum(mark) > 0).astype(np.int8), prepend=0))
        spans.append(edges.reshape(-1, 2).tolist())
        hits.append(int(sum(b - a for a, b in spans[-1])))
    return hits, spans, [sorted(x) for x in items]


def find_contamination(documents: DataFrame, benchmark: DataFrame, carry: list[str], prefix: str = "") -> DataFrame:
    """The columns `carry` of every row of `documents`, and n_words, n_hit, spans (first word, end) and items (sorted), their names after `prefix`."""
    spark = small_batches(documents).sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    added = T.StructType.fromDDL(f"{prefix}n_words long, {prefix}n_hit long, {prefix}spans array<array<long>>, {prefix}items array<string>")
    shares = []
    for k in range(blocks):  # each holds about BLOCK_BYTES of text
        share = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shares.append(spark.sparkContext.broadcast([(row[0], row[1]) for row in share]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontamination")
        one = Phrases(shares[0].value) if len(shares) == 1 else None

        def block_by_block() -> Iterator[Phrases]:
            if one is not None:
                yield one
            else:
                for share in shares:
                    yield Phrases(share.value)

        def done(rows: list[pa.RecordBatch], shard: list[list[str]]) -> pa.RecordBatch:
            hits, spans, found = searched(shard, block_by_block())
            held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [*held.columns[1:], pa.array([len(x) for x in shard], pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))],
                names=[*carry, *added.names],
            )

        rows, shard, size = [], [], 0
        for batch in batches:
            at = 0
            texts = batch.column(0).to_pylist()
            for k, text in enumerate(texts):
                shard.append(words_of(text))
                size += len(text or "") + 64
                if size >= SHARD_BYTES:
                    yield done([*rows, batch.slice(at, k + 1 - at)], shard)
                    rows, shard, size, at = [], [], 0, k + 1
            if at < len(texts):
                rows.append(batch.slice(at))
        if shard:
            yield done(rows, shard)

    kept = [documents.schema[name] for name in carry]
    return documents.select(F.col("text").alias(spare_name("searched", carry)), *carry).mapInArrow(search, T.StructType([*kept, *added]))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts, a digest of the items and the verdict for every document."""
    found = find_contamination(documents, benchmark, ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def is_contaminated(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_hit") > 0) & (20 * F.col(f"{prefix}n_hit") >= F.col(f"{prefix}n_words"))


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, all their columns."""
    prefix = "_found_"
    while any(c.lower().startswith(prefix) for c in documents.columns):
        prefix = f"_{prefix}"
    found = find_contamination(documents, benchmark, documents.columns, prefix)
    return found.filter(~is_contaminated(prefix)).select(*documents.columns)
