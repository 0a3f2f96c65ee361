"""Aligning the tokens of two tokenizers by the bytes that they stand for.

A text's tokens under A and under B cover the same bytes.  Each byte gets a label:
no token ends there, one of A does, one of B does, or both do.  A regular
expression scans the string of labels for spans up to the next byte with both;
the labels of a span count its tokens, so it is a group of tokens that stand for
each other.  Inside a group every single label begins one more pair of tokens that
overlap, a link.

Texts are cut where neither tokenizer ever joins what stands on both sides, before
a single space or line feed; such units are shared by many texts, are encoded and
aligned once, and kept by a worker in bounded memory, as numbers into arrays.  A
chunk's new units are handled together: those of Latin letters and no white space
inside go through A as one text.  Where the tokenizers don't allow that, a text is
one unit.

The links of a chunk of documents are written once, as numbers of the chunk's
distinct pairs.  Documents by pair are counted over all chunks, first in the
chunk, then in the task, then in a shuffle.  The counts come back in runs of A's
ids of about a million pairs each, broadcast one after the other; there can't be
more pairs than ids of A times ids of B.

Defined cases: a null or empty text has no tokens, nor has one whose tokens' bytes,
of A or of B, aren't those of a space and the text; texts are aligned whole; each
row is a document of its own, also if ids repeat or are null; no rows give none;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, merging_engine
from .tables import checkpointed, small_batches
from .worker import begin, kept

#: Bytes of text in a chunk, about; bytes of what is known of units, and of a unit's beside its texts and links.
CHUNK_BYTES, UNITS_BYTES, UNIT_BYTES = 2 << 20, 96 << 20, 250
#: Pairs that a task adds up, and that are broadcast at a time, about; broadcasts between two cuts of lineage.
TOGETHER, RUN, BETWEEN = 1 << 21, 1 << 20, 4
#: Labels of a byte.
NEITHER, A_ENDS, B_ENDS, BOTH = b".abx"
SPAN = re.compile(rb"[^x]*x")
#: A unit begins the text or at a single space (or line feed) between two other characters, and goes on to the next such place.
UNIT = {clean: re.compile(rf"(?:^\s*|{clean})\S*(?:(?!{clean}\S)\s+\S*)*") for clean in ("[ \n]", " ")}
#: A unit that can stand between others in one text: what all libraries take alike for letters, digits and the like, without white space.
PLAIN = re.compile("[ \n][!-~\xa1-\u024f]{1,500}")


def label_string(a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """By byte, up to the last end, which tokens end there."""
    labels = np.full(int(a_ends[-1]) if len(a_ends) else 0, NEITHER, np.uint8)
    labels[a_ends - 1] = A_ENDS
    labels[b_ends - 1] = np.where(labels[b_ends - 1] == A_ENDS, BOTH, B_ENDS)
    return labels.tobytes()


def aligned(labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each link its token of A and of B, by their places; of each group how many links, tokens of A and tokens of B it has.

    Without the bytes where nothing ends, every label closes a link, and a span of them
    is a group: its labels, less those of the other side, are its tokens.
    """
    ends = labels.translate(None, bytes([NEITHER]))
    links = np.array([*map(len, SPAN.findall(ends))], np.int64)
    kinds = np.frombuffer(ends, np.uint8)
    a, b = (np.concatenate(([0], np.cumsum(kinds != other))) for other in (B_ENDS, A_ENDS))
    last = np.cumsum(links)
    return a[:-1], b[:-1], links, np.diff(a[last], prepend=0), np.diff(b[last], prepend=0)


class Units(NamedTuple):
    """By unit the numbers of tokens of A and B, of groups and of links (no groups: the bytes differ, all are 0), and the groups as text, a semicolon after each; and all their links, A's id in the upper half of 64 bits."""

    counts: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray


class Aligner:
    """Tokenizers A (the text of a `tokenizers` file) and B (a `sentencepiece` model)."""

    def __init__(self, vocabulary: str, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(vocabulary), SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        spelt = lambda word: bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
        words = {number: spelt(word) for word, number in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [words.get(k, b"") for k in range(max(words, default=-1) + 1)]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, words)], np.int64) for words in (self.a_bytes, self.b_bytes))
        # ids as text: of A inside a group and at its end, of B inside and at the end
        self.written = [b"%d%s" % (k, mark) for n, marks in ((len(self.a_bytes), (b",", b"|")), (len(pieces), (b",", b";"))) for mark in marks for k in range(n)]
        self.written_sizes = np.array([*map(len, self.written)], np.int64)
        known = json.loads(vocabulary)
        cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        alone = not known["normalizer"] and cut.items() <= (known["pre_tokenizer"] or {}).items() and not any(re.search("[^▁]▁", p) for p in pieces)
        lines = self.b.encode("\nx", out_type=str)[:2] == ["▁", "<0x0A>"] and not any("\n" in p for p in pieces)
        self.find: Callable[[str], list[str]] = UNIT["[ \n]" if lines else " "].findall if alone else lambda text: [text]
        self.engine = merging_engine(vocabulary) if alone and all(x["special"] for x in known["added_tokens"]) else None

    def units(self, text: str) -> list[str]:
        return self.find(" " + text) if text else []

    def encoded(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, unit after unit, and how many each has; the same of B.  A unit that begins with a line feed loses the space that B puts before any text."""
        plain = np.fromiter((PLAIN.fullmatch(u) is not None for u in units), bool, len(units)) if self.engine else np.zeros(len(units), bool)
        ids = np.array(self.engine("".join(compress(units, plain))) if self.engine else [], np.int64)
        a_n = np.zeros(len(units), np.int64)
        a_n[plain] = np.diff(np.searchsorted(np.cumsum(self.a_sizes[ids]), np.cumsum(sizes[plain])) + 1, prepend=0)
        if not plain.all():
            others = [x.ids for x in self.a.encode_batch_fast([*compress(units, ~plain)], add_special_tokens=False)]  # without offsets, which nothing asks for
            a_n[~plain] = [*map(len, others)]
            of = np.repeat(plain, a_n)
            both = np.empty(len(of), np.int64)
            both[of], both[~of] = ids, [*chain.from_iterable(others)]
            ids = both
        b = self.b.encode([u.removeprefix(" ") for u in units], num_threads=1)
        b = [y if u[:1] == " " else y[1:] for u, y in zip(units, b, strict=True)]
        return ids, a_n, np.array([*chain.from_iterable(b)], np.int64), np.array([*map(len, b)], np.int64)

    def tokens(self, units: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B of each unit."""
        a, a_n, b, b_n = self.encoded(units, np.array([len(u.encode()) for u in units], np.int64))
        return zip(*([x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if units else [] for ids, n in ((a, a_n), (b, b_n))), strict=True)

    def measured(self, units: list[str]) -> Units:
        """All units are aligned in one pass: every unit's last byte has both labels."""
        data = [u.encode() for u in units]
        sizes = np.array([*map(len, data)], np.int64)
        a, a_n, b, b_n = self.encoded(units, sizes)
        sides = ((a, a_n, self.a_bytes, self.a_sizes), (b, b_n, self.b_bytes, self.b_sizes))
        fits = np.logical_and.reduce([by_part(by_id[ids], n) == sizes for ids, n, _, by_id in sides])
        places, wanted = np.flatnonzero(fits), np.frombuffer(b"".join(compress(data, fits)), np.uint8)
        ends = np.cumsum(sizes[places])
        spelt = [np.frombuffer(b"".join(map(words.__getitem__, ids[np.repeat(fits, n)].tolist())), np.uint8) for ids, n, words, _ in sides]
        for found in spelt:
            fits[places[np.searchsorted(ends, np.flatnonzero(found != wanted), side="right")]] = False
        a, b, a_n, b_n = a[np.repeat(fits, a_n)], b[np.repeat(fits, b_n)], a_n[fits], b_n[fits]
        a_of, b_of, links, a_in, b_in = aligned(label_string(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])))

        # of each group the ids of A, then those of B, the last of each with another mark
        a_until, b_until = np.cumsum(a_in), np.cumsum(b_in)
        a_at, b_at = np.arange(len(a)) + np.repeat(b_until - b_in, a_in), np.arange(len(b)) + np.repeat(a_until, b_in)
        order = np.empty(len(a) + len(b), np.int64)
        order[a_at], order[b_at] = a, b + 2 * len(self.a_bytes)
        order[a_at[a_until - 1]] += len(self.a_bytes)
        order[b_at[b_until - 1]] += len(self.b_bytes)
        text = b"".join(map(self.written.__getitem__, order.tolist()))
        n_groups = np.diff(np.searchsorted(a_until, np.cumsum(a_n)) + 1, prepend=0)
        until = np.zeros(len(units), np.int64)
        until[fits] = by_part(self.written_sizes[order], a_n + b_n)
        until = np.cumsum(until).tolist()
        counts = np.zeros((len(units), 4), np.int64)
        counts[fits] = np.stack((a_n, b_n, n_groups, by_part(links, n_groups)), axis=1)
        return Units(counts, [text[i:j] for i, j in zip([0, *until], until, strict=False)], a[a_of] << 32 | b[b_of])

    def align(self, units: list[str]) -> dict[str, tuple[int, int, int, str, bytes] | None]:
        """By unit the numbers of tokens of A and B and of groups, the groups as text, and the links; None if the bytes differ."""
        found = self.measured(units)
        pairs = np.split(found.pairs, np.cumsum(found.counts[:, 3])[:-1])
        return {u: (*n[:3], text[:-1].decode(), x.tobytes()) if n[2] else None for u, n, text, x in zip(units, found.counts.tolist(), found.groups, pairs, strict=True)} if units else {}


class Known(dict):
    """The numbers of units, and by number what is known of them.  When those asked for since the last such time take half of `most` bytes, all others are forgotten."""

    def __init__(self, aligner: Aligner, most: int) -> None:
        super().__init__()
        self.aligner, self.most, self.new = aligner, most, []
        self.counts, self.groups, self.pairs = np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64)
        self.bytes, self.asked = np.zeros(0, np.int64), np.zeros(0, bool)

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = number = len(self)
        return number

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of the texts by their numbers, which hold until the next call, and how many each text has."""
        if self.bytes[self.asked].sum() >= self.most // 2:
            self.forget()
        at, sizes, number = [], [], self.__getitem__
        for text in texts:
            units = self.aligner.units(text)
            at += map(number, units)
            sizes.append(len(units))
        at = np.array(at, np.int64)
        if self.new:
            found = self.aligner.measured(self.new)
            self.counts = np.concatenate((self.counts, found.counts))
            self.groups += found.groups
            self.pairs = np.concatenate((self.pairs, found.pairs))
            lengths = np.array([*map(len, self.new)], np.int64) + np.array([*map(len, found.groups)], np.int64)
            self.bytes = np.concatenate((self.bytes, UNIT_BYTES + lengths + 8 * found.counts[:, 3]))
            self.asked = np.concatenate((self.asked, np.zeros(len(self.new), bool)))
            self.new = []
        self.asked[at] = True
        return at, np.array(sizes, np.int64)

    def forget(self) -> None:
        stays = [*compress(self, self.asked)]
        self.pairs = self.pairs[np.repeat(self.asked, self.counts[:, 3])]
        self.counts, self.groups, self.bytes = self.counts[self.asked], [*compress(self.groups, self.asked)], self.bytes[self.asked]
        self.asked = np.zeros(len(stays), bool)
        self.clear()
        self.update(zip(stays, range(len(stays)), strict=True))


def squeezed(*parts: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as one compressed string, each after its length."""
    data = b"".join(x for part in parts for x in (len(part).to_bytes(8, "little"), np.ascontiguousarray(part, np.int64).tobytes()))
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> list[np.ndarray]:
    values = np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), np.int64)
    parts, at = [], 0
    while at < len(values):
        parts.append(values[at + 1 : at + 1 + values[at]])
        at += 1 + int(values[at])
    return parts


def by_part(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begins], np.add.reduceat(weights, begins) if len(begins) else np.zeros(0, np.int64)


def linked_chunk(known: Known, texts: list[str]) -> dict:
    """By document the numbers and the hash; the chunk's distinct pairs; and each document's pairs, by their numbers here, with how often it has them."""
    at, sizes = known.numbers(texts)
    fits = by_part(known.counts[at, 2] == 0, sizes) == 0
    at, sizes = at[np.repeat(fits, sizes)], np.where(fits, sizes, 0)
    counts = known.counts[at]
    numbers = [by_part(counts[:, k], sizes) for k in range(4)]
    coded, until = at.tolist(), np.cumsum(sizes).tolist()
    groups = known.groups.__getitem__
    hashes = [hashlib.sha256(b"".join(map(groups, coded[i:j]))[:-1]).hexdigest() if i < j else "" for i, j in zip([0, *until], until, strict=False)]

    here = np.zeros(len(known), bool)
    here[at] = True
    at, n_local = (np.cumsum(here) - 1)[at], int(here.sum())
    links = known.counts[here, 3]
    keys, number = np.unique(known.pairs[np.repeat(here, known.counts[:, 3])], return_inverse=True)
    first = np.cumsum(links) - links

    document = np.repeat(np.arange(len(texts)), sizes)
    unit, times = summed(document * max(1, n_local) + at, np.ones(len(at), np.int64))
    document, unit = np.divmod(unit, max(1, n_local))
    many = links[unit]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pair, times = summed(np.repeat(document, many) * max(1, len(keys)) + number[np.repeat(first[unit], many) + inside], np.repeat(times, many))
    document, pair = np.divmod(pair, max(1, len(keys)))
    own = np.bincount(document, minlength=len(texts))
    used = np.bincount(pair, minlength=len(keys))
    step = np.diff(pair, prepend=0)  # small numbers, but for each document's first
    return dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers, strict=True)) | {"groups_sha256": hashes, "pairs": squeezed(keys, used), "links": squeezed(own, step, times)}


DIGESTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
CHUNK = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, links binary"


def linked_chunks(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    with open(a_path, encoding="utf-8") as file, open(b_path, "rb") as other:
        models = documents.sparkSession.sparkContext.broadcast((file.read(), other.read()))  # of fixed size

    def aligned_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("alignment")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        name = hashlib.md5(models.value[0].encode() + models.value[1]).hexdigest()
        known = kept(f"units_{name}", lambda: Known(Aligner(*models.value), UNITS_BYTES))

        def chunk() -> pa.RecordBatch:
            row = {"doc_id": ids} | linked_chunk(known, texts)
            types = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), types, strict=True)], names=list(row))

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1]) + 64
                if size >= CHUNK_BYTES:
                    yield chunk()
                    ids, texts, size = [], [], 0
        if ids:
            yield chunk()

    return checkpointed(small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(aligned_texts, CHUNK))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b and n: how many documents have the pair linked."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("alignment")
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for data in batch.column(0):
                waiting.append(expanded(data.as_py()))
                if sum(len(x) for x, _ in waiting) > TOGETHER:
                    keys, counts = (np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True))
                    (keys, counts), waiting = summed(keys, counts), []
                    if len(keys) > TOGETHER:
                        yield rows()
                        keys, counts = keys[:0], counts[:0]
        keys, counts = summed(*(np.concatenate(x) for x in zip((keys, counts), *waiting, strict=True)))
        yield rows()

    return checkpointed(chunks.select("pairs").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))


def valued(chunks: DataFrame, run: Broadcast) -> DataFrame:
    """`chunks` whose n_best and count_sum have risen by what the pairs of `run` give."""

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("alignment")
        keys, counts, best = run.value
        for batch in batches:
            sums = {"n_best": [], "count_sum": []}
            for row in range(batch.num_rows):
                (own_keys, _), (sizes, step, times) = (expanded(batch.column(c)[row].as_py()) for c in ("pairs", "links"))
                place = np.minimum(np.searchsorted(keys, own_keys), len(keys) - 1)
                here = keys[place] == own_keys
                pair = np.cumsum(step)
                for name, value in (("n_best", np.where(here, best[place], 0)), ("count_sum", np.where(here, counts[place], 0))):
                    sums[name].append(by_part(value[pair] * times, sizes) + np.array(batch.column(name)[row].as_py(), np.int64))
            columns = [pa.array([x.tolist() for x in sums[name]], pa.list_(pa.int64())) if name in sums else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return chunks.mapInArrow(raised, chunks.schema)


def align_tokens(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every document."""
    chunks = linked_chunks(documents, a_path, b_path)
    counts = pair_counts(chunks)
    of_a = sorted((r[0], r[1]) for r in counts.groupBy("a").count().collect())  # A's ids at most
    runs, size = [], RUN
    for a, n in of_a:
        if size >= RUN:
            runs, size = [*runs, [a, a]], 0
        runs[-1][1], size = a, size + n
    out = chunks.withColumns({name: F.transform("n_a", lambda _: F.lit(0).cast("long")) for name in ("n_best", "count_sum")})
    for k, (first, last) in enumerate(runs):
        rows = counts.filter(F.col("a").between(first, last)).toArrow()
        a, b, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
        order = np.argsort(a << 32 | b)
        a, b, n = a[order], b[order], n[order]
        begins = np.flatnonzero(np.diff(a, prepend=-1))
        greatest = np.repeat(np.maximum.reduceat(n, begins), np.diff(begins, append=len(a)))
        out = valued(out, documents.sparkSession.sparkContext.broadcast((a << 32 | b, n, n == greatest)))
        if k % BETWEEN == BETWEEN - 1:
            out = checkpointed(out)
    columns = [*DIGESTS[:5], "n_best", "count_sum", "groups_sha256"]
    return out.select(F.inline(F.arrays_zip(*columns))).select(*columns)
