"""Packing by powers of two: every document is cut into pieces of binary lengths.

A document of n tokens (its ids and a closing id) is cut into pieces of the
greatest length, a power of two, and then into one piece for each binary digit of
what is left, longest first.  Pieces of one length make up a bucket; each is a
sequence of its own, so no sequence crosses documents and none is padded.

Sequence ids are gapless: buckets by falling length, in a bucket by cells of the
piece's hash and in a cell by document and start.  Only the number of pieces by
length and cell reaches the driver.

Ids are little-endian unsigned 32-bit numbers on the machines that Spark runs on.

Defined cases: a null text is empty and has the closing id alone; texts are
encoded whole; equal rows give pieces each of their own; no rows give none; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECES, WORDS_BYTES, byte_letters, spaced_apart
from .tables import checkpointed
from .token_counts import vocabulary
from .worker import Cache, begin, kept

CELLS = 4096


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two up to `longest` that add up to n, falling, as few as can be."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def word_engine(text: str) -> Callable[[str], list[int]] | None:
    """tiktoken's merging of single words under the same vocabulary, several times as fast; None where its ids don't follow the order of merges, by which that engine goes."""
    import tiktoken

    spec, letters = json.loads(text), byte_letters()
    ranks = {bytes(letters[c] for c in word): number for word, number in spec["model"]["vocab"].items() if all(c in letters for c in word)}
    pairs = (merge.split(" ") if isinstance(merge, str) else merge for merge in spec["model"]["merges"])
    merged = [ranks.get(bytes(letters[c] for c in a + b), -1) for a, b in pairs]
    for added in spec["added_tokens"]:
        ranks.pop(added["content"].encode(), None)
    if merged != sorted(set(merged)) or merged[:1] == [-1]:
        return None
    return tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def identifier(text: str) -> Callable[[str], bytes]:
    """A function that gives a text's ids, four bytes each, as the `tokenizers` library does.  Words that stand between single spaces are encoded apart, which gives the same, and kept."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    name = hashlib.md5(text.encode()).hexdigest()
    library = kept(f"library_{name}", lambda: Tokenizer.from_str(text))
    added = kept(f"added_{name}", lambda: [x.content for x in library.get_added_tokens_decoder().values()])
    engine = kept(f"engine_{name}", lambda: word_engine(text)) or (lambda part: library.encode(part, add_special_tokens=False).ids)

    def encoded(part: str) -> bytes:
        return array("I", library.encode(part, add_special_tokens=False).ids).tobytes()

    after_space = kept(f"ids_{name}", lambda: Cache(lambda word: array("I", engine(" " + word)).tobytes(), WORDS_BYTES))

    def ids_of(document: str) -> bytes:
        if not spaced_apart(document) or any(x in document for x in added):
            return encoded(document)
        first, *words = document.split(" ")
        return encoded(first) + b"".join(map(after_space.__getitem__, words))

    return ids_of


def pieces(documents: DataFrame, path: str, longest: int, closing_id: int, with_ids: bool) -> DataFrame:
    """Every piece with its place in its document; its ids too if asked for."""
    words = vocabulary(documents, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        ids_of = identifier(words.value)
        closing = struct.pack("<I", closing_id)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids_of(text or "") + closing
                start, total = 0, len(data) // 4
                for length in binary_lengths(total, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, *([list(struct.unpack(f"<{length}I", piece))] if with_ids else [])))
                    start += length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(documents: DataFrame, path: str, longest: int = 1024, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All pieces with sequence_id and offset (always 0).  The vocabulary is that of the file at `path`."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length has to be a power of two")
    cut = checkpointed(pieces(documents, path, longest, closing_id, with_ids)).withColumn("_cell", F.pmod(F.xxhash64("doc_id", "start"), F.lit(CELLS)).cast("int"))
    counts = cut.groupBy("length", "_cell").count().collect()  # CELLS for each power of two at most
    bases, base = [], 0
    for row in sorted(counts, key=lambda r: (-r[0], r[1])):
        bases.append((row[0], row[1], base))
        base += row[2]
    placed = cut.sparkSession.createDataFrame(bases, "length long, _cell int, _base long")
    rank = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("_rank", rank).join(F.broadcast(placed), ["length", "_cell"])
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_rank") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
