"""Asking all documents about the hashes that some of them hold.

Documents are packed into chunks of about a megabyte, compressed, and written to
the shared checkpoint folder; a chunk's id then stands for its place, however
often tasks are run again.  A question goes from chunks to buckets of hashes as
packed bytes, one row for each chunk and bucket, and the answers come back to the
chunk in the same order.  Nothing is keyed by a single hash, so that no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed, parallelism, small_batches, spare_name
from .worker import begin

CHUNK_BYTES = 1 << 20
#: Bytes of text for which a bucket stands at most.
BUCKET_BYTES = 64 << 20
#: What stands for a null document id: before all others.
NULL_ID = -(1 << 63)


def pack_chunks(documents: DataFrame, carry: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk (long), ids (of documents; NULL_ID for null), sizes, data (the UTF-8 of their texts, compressed) and rest: the columns `carry` as an Arrow stream.  A document isn't split."""
    carry = carry or []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        task, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, size, rest = [], [], 0, []

        def chunk() -> pa.RecordBatch:
            data = b"".join(texts)
            squeezed = pa.compress(data, codec="zstd", asbytes=True)
            columns = [[task + number], [ids], [[len(x) for x in texts]], [squeezed], [streamed(rest) if carry else None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()], strict=True)], names=["chunk", "ids", "sizes", "data", "rest"])

        for batch in batches:
            at = 0
            others = pa.RecordBatch.from_arrays(batch.columns[2:], names=carry) if carry else batch
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(NULL_ID if doc_id is None else doc_id)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= chunk_bytes:
                    rest.append(others.slice(at, k + 1 - at))
                    yield chunk()
                    ids, texts, size, rest, number, at = [], [], 0, [], number + 1, k + 1
            if at < batch.num_rows:
                rest.append(others.slice(at))
        if ids:
            yield chunk()

    names = [spare_name(x, carry) for x in ("chunk_id", "chunk_text")]
    return checkpointed(small_batches(documents).select(F.col("doc_id").cast("long").alias(names[0]), F.col("text").alias(names[1]), *carry).mapInArrow(packed, "chunk long, ids array<long>, sizes array<long>, data binary, rest binary"))


def streamed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unstreamed(rest: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rest).read_all().combine_chunks().to_batches()[0]


class Chunk:
    """A chunk as its row has it."""

    def __init__(self, row: dict) -> None:
        self.chunk = row["chunk"]
        self.ids = np.array(row["ids"], np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        data = pa.decompress(row["data"], decompressed_size=int(self.sizes.sum()), codec="zstd") if self.sizes.sum() else b""
        self.data = np.frombuffer(data, np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[b : b + n] for b, n in zip(self.begins.tolist(), self.sizes.tolist(), strict=True)]


def text_bytes(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_of(documents: DataFrame, size: int) -> int:
    """Eight for each partition of a shuffle, so that partitions get much the same, and as many as it takes for a bucket to stand for BUCKET_BYTES of the `size` bytes of text at most: what a worker holds at a time doesn't grow with the corpus.

    A chunk has a row for each bucket that it asks, but never more rows than hashes.
    """
    return max(8 * parallelism(documents.sparkSession), -(-size // BUCKET_BYTES))


def ask(chunks: DataFrame, question: Callable[[dict], list[tuple[int, bytes]]]) -> DataFrame:
    """bucket, chunk and payload for each (bucket, payload) that `question` has for a chunk's row."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        for batch in batches:
            for row in range(batch.num_rows):
                values = batch.slice(row, 1).to_pylist()[0]
                found = question(values)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b for b, _ in found], pa.int32()), pa.array([values["chunk"]] * len(found), pa.int64()), pa.array([p for _, p in found], pa.binary())],
                        names=["bucket", "chunk", "payload"],
                    )

    return chunks.mapInArrow(asked, "bucket int, chunk long, payload binary")


def answer(questions: DataFrame, reply: Callable[[list[int], list[bytes]], list[bytes]], name: str) -> DataFrame:
    """chunk and, in column `name`, its buckets' answers.  `reply` gets the chunks and payloads of one bucket, and gives one answer for each."""

    def replied(table: pa.Table) -> pa.Table:
        begin("exchange")
        payloads = table.column("payload").to_pylist()
        answers = reply(table.column("chunk").to_pylist(), payloads)
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "answer": pa.array(answers, pa.binary())})

    answered = questions.groupBy("bucket").applyInArrow(replied, "bucket int, chunk long, answer binary")
    return answered.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))


def by_bucket(answers: list[dict] | None) -> dict[int, bytes]:
    return {x["bucket"]: x["answer"] for x in answers or ()}


def split_by(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts keys (0 to count - 1) together, and where each key's begin."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(count + 1))
