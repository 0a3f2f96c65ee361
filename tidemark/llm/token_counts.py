"""Exact token counts at every prefix, without encoding a text again.

`bpe.Encoder` finds by dynamic programming the number of tokens of every prefix
of a piece.  Pieces are encoded apart, so a text's count is the sum of its pieces'
last prefixes, and a prefix's count is that of the pieces before it plus one entry
of the piece that it cuts.  Words are shared by many texts; a worker keeps what it
found for the latest ones, a bounded number.

Defined cases: a null text is empty and has no tokens; texts of any length are
counted whole; equal rows give equal rows; no rows give none; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .bpe import WORDS_BYTES, Encoder, prefix_counts, spaced_apart
from .tables import small_batches
from .worker import Cache, begin, kept


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The text of a vocabulary file, for all workers; its size is that of the file, whatever the input."""
    small_batches(df)
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoder_of(text: str) -> Encoder:
    begin("token_counts")
    name = "encoder_" + hashlib.md5(text.encode()).hexdigest()
    return kept(name, lambda: Encoder(text))


def counter(text: str) -> Callable[[str], int]:
    """A function that counts tokens under a vocabulary."""
    encoder = encoder_of(text)
    name = hashlib.md5(text.encode()).hexdigest()
    after_space = kept(f"counts_{name}", lambda: Cache(lambda word: encoder.count(" " + word), WORDS_BYTES))

    def count(document: str) -> int:
        if not spaced_apart(document) or any(x in document for x in encoder.added):
            return encoder.count(document)
        first, *words = document.split(" ")
        return encoder.count(first) + sum(map(after_space.__getitem__, words))

    return count


def count_tokens(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether that is over `limit`, for every document."""
    words = vocabulary(documents, path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(words.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([x > limit for x in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncate(documents: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix (in characters) whose own encoding has `budget` tokens at most, with its count."""
    words = vocabulary(documents, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(words.value)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                counts = prefix_counts(encoder, text or "")
                end = max((i for i, n in enumerate(counts) if n <= budget), default=0)
                rows.append(((text or "")[:end], end, counts[end]))
            kept_text, ends, tokens = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept_text, pa.string()), pa.array(ends, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "text", "n_chars", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id long, text string, n_chars long, n_tokens long")
