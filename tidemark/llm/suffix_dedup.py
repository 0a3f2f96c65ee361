"""Removal of repeated byte strings by a distributed suffix array.

Every byte that a string of LENGTH bytes covers is removed if the string also
starts earlier: in a document of smaller id, or earlier in the same one.  Strings
are judged on the input.

1. Each string of LENGTH bytes has an anchor: the GRAM-byte piece in it of least
   hash, the leftmost of equal ones.  Equal strings have equal anchors at the same
   offset.  Successive strings of one anchor make up a context.
2. Chunks ask which of their anchors occur elsewhere too (`exchange`).  A context
   whose anchor occurs once holds no repeated string.
3. The other contexts go to their anchor's bucket.  There equal contexts are one
   class.  Of anchors with several classes the suffixes are sorted by bucket-pointer
   refinement: buckets of 8 bytes are refined by the bucket identifiers found
   further on, depth 8 to 16, 32, 64 and LENGTH, each step using the last one's
   identifiers.  Buckets of one suffix aren't refined further.
4. Chunks get a bit for each of their strings and cover, merge and remove.

An anchor that occurs HOT times or more (a passage in very many documents) isn't
gathered in its bucket: its strings go one by one to the buckets of their own
hashes, after equal ones in a chunk have been made one, and are sorted there by the
same refinement.  So hashes only deal strings out; bytes decide everywhere, and HOT
changes the plan, not the result.

Defined cases: a null text is empty; texts under LENGTH bytes lose nothing; rows
with one id count as one document, so that a string at the same place in two of
them is no repetition; a null id comes before all others; extra columns are
not read; no rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import CHUNK_BYTES, NULL_ID, Chunk, answer, ask, buckets_of, by_bucket, pack_chunks, split_by, text_bytes, unstreamed
from .worker import begin

LENGTH = 100
GRAM = 32
#: Occurrences from which an anchor's strings are dealt out one by one.
HOT = 4096
#: Chunks among which a hot string is made one before its earliest place is sought in all of them.
PART_CHUNKS = 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """A polynomial hash of each `length`-byte piece, by doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    out, done, power = data.astype(np.uint64) + np.uint64(1), 1, base
    full, have = None, 0  # the hash of the first `have` bytes, of the binary digits seen
    rest = length
    while rest:
        if rest & 1:
            if full is None:
                full, have = out, done
            else:
                n = len(data) - (have + done) + 1
                full = full[:n] * np.uint64(pow(base, done, 1 << 64)) + out[have : have + n]
                have += done
        rest >>= 1
        if rest:
            n = len(out) - done
            out = out[:n] * np.uint64(power) + out[done : done + n]
            power, done = power * power % (1 << 64), done * 2
    return mixed(full)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of the least, the leftmost of equal ones."""
    least, place, done = values, np.arange(len(values), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        n = len(least) - step
        later = least[step : step + n] < least[:n]
        place = np.where(later, place[step : step + n], place[:n])
        least = np.where(later, least[step : step + n], least[:n])
        done += step
    return place


class Contexts:
    """The contexts of a chunk: start and number of strings, anchor hash, document."""

    def __init__(self, chunk: Chunk) -> None:
        data = chunk.data
        empty = np.zeros(0, np.int64)
        self.start, self.count, self.document, self.anchor = empty, empty, empty, empty.astype(np.uint64)
        if len(data) < LENGTH:
            return
        hashes = gram_hashes(data, GRAM, 0x9E3779B97F4A7C15)
        place = leftmost_minima(hashes, LENGTH - GRAM + 1)
        document = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)[: len(place)]
        ends = (chunk.begins + chunk.sizes)[document]
        inside = np.arange(len(place)) + LENGTH <= ends
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (document[1:] != document[:-1])
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= first[1:] | ~inside[1:]
        self.count = np.flatnonzero(last) - self.start + 1
        self.document = document[self.start]
        self.anchor = mixed(hashes[place[self.start]] + np.uint64(0x9E3779B97F4A7C15))  # minima are small: mixed again they are spread evenly


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def asked_anchors(contexts: Contexts, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By bucket: the distinct anchors of a chunk, sorted, and how often each occurs (255 at most)."""
    anchors, counts = np.unique(contexts.anchor, return_counts=True)
    edges = np.searchsorted(bucket_of(anchors, buckets), np.arange(buckets + 1))
    for bucket in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        mine = slice(edges[bucket], edges[bucket + 1])
        yield bucket, anchors[mine], np.minimum(counts[mine], 255).astype(np.uint8)


def repeated_anchors(payloads: list[bytes], hot: int) -> list[bytes]:
    """For each anchor of each payload 0 (occurs once), 1 or 2 (hot)."""
    sizes = [len(p) // 9 for p in payloads]
    anchors = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(p, np.uint8, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)])
    order = np.argsort(anchors)
    ordered = anchors[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    total = np.add.reduceat(counts[order].astype(np.int64), heads)
    kind = np.zeros(len(anchors), np.uint8)
    kind[order] = np.repeat(np.where(total >= hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8), np.diff(np.append(heads, len(ordered))))
    return [x.tobytes() for x in np.split(kind, np.cumsum(sizes)[:-1])]


def kinds(contexts: Contexts, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    """The answer for each context."""
    if not len(contexts.anchor):
        return np.zeros(0, np.uint8)
    anchors, at = np.unique(contexts.anchor, return_inverse=True)
    found = np.zeros(len(anchors), np.uint8)
    edges = np.searchsorted(bucket_of(anchors, buckets), np.arange(buckets + 1))
    for bucket, said in answers.items():
        found[edges[bucket] : edges[bucket + 1]] = np.frombuffer(said, np.uint8)
    return found[at]


class Hot:
    """The strings of hot contexts in a chunk, equal ones as one: hash and bytes, document id and start of the earliest."""

    def __init__(self, chunk: Chunk, contexts: Contexts, kind: np.ndarray) -> None:
        mine = np.flatnonzero(kind == 2)
        count = contexts.count[mine]
        self.start = np.repeat(contexts.start[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        document = np.repeat(contexts.document[mine], count)
        self.id, self.place = chunk.ids[document], self.start - chunk.begins[document]
        if not len(mine):
            self.hashes, self.bytes = np.zeros(0, np.uint64), np.zeros((0, LENGTH), np.uint8)
            self.first = self.of = np.zeros(0, np.int64)
            return
        strings = np.lib.stride_tricks.sliding_window_view(chunk.data, LENGTH)[self.start]
        distinct, self.of = np.unique(strings.view(f"S{LENGTH}").ravel(), return_inverse=True)  # the class of each string
        order = np.lexsort((self.place, self.id, self.of))
        self.first = order[np.concatenate(([True], self.of[order][1:] != self.of[order][:-1]))]  # its earliest
        self.bytes = strings[self.first]
        self.hashes = gram_hashes(chunk.data, LENGTH, 0xD6E8FEB86659FD93)[self.start[self.first]]


class Plain:
    """The contexts of other anchors that occur elsewhere, equal ones in a chunk as one: document id and place of each, and the earliest of each class."""

    def __init__(self, chunk: Chunk, contexts: Contexts, kind: np.ndarray) -> None:
        mine = np.flatnonzero(kind == 1)
        self.start, self.count, self.anchor = contexts.start[mine], contexts.count[mine], contexts.anchor[mine]
        document = contexts.document[mine]
        self.id, self.place = chunk.ids[document], self.start - chunk.begins[document]
        raw, numbers = chunk.data.tobytes(), {}
        ends = self.start + self.count + LENGTH - 1
        self.of = np.array([numbers.setdefault(raw[b:e], len(numbers)) for b, e in zip(self.start.tolist(), ends.tolist(), strict=True)], np.int64)
        self.texts = list(numbers)
        order = np.lexsort((self.place, self.id, self.of))
        self.first = order[np.concatenate(([True], self.of[order][1:] != self.of[order][:-1]))] if len(order) else order

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The earliest contexts in the order of their anchors' buckets, and where each bucket's begin."""
        order, edges = split_by(bucket_of(self.anchor[self.first], buckets), buckets)
        return self.first[order], edges


RECORD = np.dtype([("anchor", "<u8"), ("id", "<i8"), ("place", "<i8"), ("count", "u1")])
STRING = np.dtype([("id", "<i8"), ("place", "<i8"), ("bytes", "u1", LENGTH)])


def context_payloads(chunk: Chunk, contexts: Contexts, kind: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Contexts with their bytes, and hot strings by their hashes, to the buckets that judge them."""
    out = []
    plain = Plain(chunk, contexts, kind)
    mine, edges = plain.by_bucket(buckets)
    records = np.empty(len(mine), RECORD)
    records["anchor"], records["count"] = plain.anchor[mine], plain.count[mine]
    records["id"], records["place"] = plain.id[mine], plain.place[mine]
    of = plain.of[mine].tolist()
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        lo, hi = edges[b], edges[b + 1]
        out.append((2 * b, records[lo:hi].tobytes() + b"".join(plain.texts[k] for k in of[lo:hi])))
    hot = Hot(chunk, contexts, kind)
    order, edges = split_by(bucket_of(hot.hashes, buckets), buckets)
    strings = np.empty(len(order), STRING)
    first = hot.first[order]
    strings["id"], strings["place"], strings["bytes"] = hot.id[first], hot.place[first], hot.bytes[order]
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        out.append((2 * b + 1, strings[edges[b] : edges[b + 1]].tobytes()))
    return out


def earliest(heads: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least (id, place) of each group, groups beginning at `heads`, for every member."""
    sizes = np.diff(np.append(heads, len(ids)))
    least = np.repeat(np.minimum.reduceat(ids, heads), sizes)
    place = np.minimum.reduceat(np.where(ids == least, places, np.iinfo(np.int64).max), heads)
    return least, np.repeat(place, sizes)


def identifiers(keys: np.ndarray) -> np.ndarray:
    """The bucket of each key: how many smaller ones there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), np.arange(len(keys)), 0))
    return out


def refined(text: np.ndarray) -> np.ndarray:
    """For each place of a text the bucket of its LENGTH bytes: equal for equal strings, in their order.  Strings that run over the end are cut there."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : k + n]
    bucket, depth = identifiers(first), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        several = np.bincount(bucket, minlength=n) > 1
        open_ = np.flatnonzero(several[bucket])  # a bucket of one suffix is done
        if not len(open_):
            break
        later = np.append(bucket, np.full(step, -1))[open_ + step] + 1
        order = np.lexsort((later, bucket[open_]))
        at, ahead = bucket[open_][order], later[order]
        new_bucket = np.concatenate(([True], at[1:] != at[:-1]))
        new = new_bucket | np.concatenate(([True], ahead[1:] != ahead[:-1]))
        # identifiers stay ranks: the bucket's own, plus the place within it
        within = np.arange(len(at)) - np.maximum.accumulate(np.where(new_bucket, np.arange(len(at)), 0))
        renamed = at + within
        updated = bucket.copy()
        updated[open_[order]] = renamed[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        bucket, depth = updated, depth + step
    return bucket


def repeated_strings(payloads: list[bytes]) -> list[bytes]:
    """For each context of each payload the bits of its strings: 1 for those that start earlier too."""
    # a payload: its records, each with `count` strings and so count + LENGTH - 1 bytes after all records
    records, texts, shares = [], [], []
    for payload in payloads:
        have = np.frombuffer(payload, RECORD, records_in(payload))
        records.append(have)
        shares.append(len(have))
        ends = have.nbytes + np.cumsum(have["count"].astype(np.int64) + LENGTH - 1)
        begin = have.nbytes
        for end in ends.tolist():
            texts.append(payload[begin:end])
            begin = end
    table = np.concatenate(records)
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(text, len(numbers)) for text in texts])  # equal contexts are one class
    order = np.lexsort((table["place"], table["id"], of))
    heads = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1])))
    first_id, first_place = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    first_id[order], first_place[order] = earliest(heads, table["id"][order], table["place"][order])
    later = (table["id"] != first_id) | (table["place"] != first_place)
    head = order[heads]  # for each class its earliest context
    # classes of one anchor are sorted against each other
    anchors = table["anchor"][head]
    by_anchor = np.argsort(anchors, kind="stable")
    ordered = anchors[by_anchor]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    mixed_ = by_anchor[same | np.append(same[1:], False)]
    bits: list[np.ndarray | None] = [None] * len(head)
    if len(mixed_):
        names = list(numbers)
        parts = [np.frombuffer(names[c], np.uint8) for c in mixed_.tolist()]
        counts = table["count"][head[mixed_]].astype(np.int64)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        bucket = refined(np.concatenate(parts))
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        strings = bucket[np.repeat(begins, counts) + step]
        ids, places = np.repeat(table["id"][head[mixed_]], counts), np.repeat(table["place"][head[mixed_]], counts) + step
        order = np.argsort(strings, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], strings[order][1:] != strings[order][:-1])))
        least, place = earliest(heads, ids[order], places[order])
        repeated = np.empty(len(strings), bool)
        repeated[order] = (ids[order] != least) | (places[order] != place)
        for c, found in zip(mixed_.tolist(), np.split(repeated, np.cumsum(counts)[:-1]), strict=True):
            bits[c] = found
    out, k = [], 0
    for share in shares:
        row = []
        for j in range(k, k + share):
            count, found = int(table["count"][j]), bits[of[j]]
            row.append(np.ones(count, bool) if later[j] else found if found is not None else np.zeros(count, bool))
        out.append(np.packbits(np.concatenate(row)).tobytes())
        k += share
    return out


def records_in(payload: bytes) -> int:
    """How many records a payload begins with: the number whose bytes and contexts fill it."""
    counts = np.frombuffer(payload, np.uint8)[RECORD.itemsize - 1 :: RECORD.itemsize]
    filled = np.cumsum(counts.astype(np.int64) + LENGTH - 1 + RECORD.itemsize)
    return int(np.searchsorted(filled, len(payload))) + 1


def refined_strings(strings: np.ndarray) -> np.ndarray:
    """For each row of LENGTH bytes its bucket: equal for equal rows.  Buckets of the first 8 bytes are refined by the buckets of the 8 bytes at later offsets."""
    grams = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    bucket = identifiers(np.ascontiguousarray(strings[:, :8]).view(">u8").ravel())
    for at in grams[1:]:
        open_ = np.flatnonzero((np.bincount(bucket, minlength=len(bucket)) > 1)[bucket])
        if not len(open_):
            break
        later = identifiers(np.ascontiguousarray(strings[open_, at : at + 8]).view(">u8").ravel())
        order = np.lexsort((later, bucket[open_]))
        own, ahead = bucket[open_][order], later[order]
        new_bucket = np.concatenate(([True], own[1:] != own[:-1]))
        new = new_bucket | np.concatenate(([True], ahead[1:] != ahead[:-1]))
        within = np.arange(len(own)) - np.maximum.accumulate(np.where(new_bucket, np.arange(len(own)), 0))
        bucket[open_[order]] = (own + within)[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
    return bucket


def in_classes(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For strings with their bytes: an order that puts equal ones together, where their classes begin, and in that order the least (id, place) of each one's class."""
    bucket = refined_strings(table["bytes"])
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])))
    return order, heads, *earliest(heads, table["id"][order], table["place"][order])


def combined_hot(payloads: list[bytes]) -> bytes:
    """The strings of all payloads, equal ones as one with their earliest place."""
    table = np.concatenate([np.frombuffer(p, STRING) for p in payloads])
    order, heads, least, place = in_classes(table)
    out = table[order[heads]]
    out["id"], out["place"] = least[heads], place[heads]
    return out.tobytes()


def earliest_hot(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its strings' earliest places in all of them."""
    table = np.concatenate([np.frombuffer(p, STRING) for p in payloads])
    order, _, least, place = in_classes(table)
    table["id"][order], table["place"][order] = least, place
    edges = np.cumsum([len(p) // STRING.itemsize for p in payloads])
    return [part.tobytes() for part in np.split(table, edges[:-1])]


def repeated_hot(payloads: list[bytes]) -> list[bytes]:
    """The same for strings of hot anchors, each by itself."""
    sizes = [len(p) // STRING.itemsize for p in payloads]
    table = np.concatenate([np.frombuffer(p, STRING) for p in payloads])
    order, _, least, place = in_classes(table)
    repeated = np.empty(len(order), bool)
    repeated[order] = (table["id"][order] != least) | (table["place"][order] != place)
    return [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum(sizes)[:-1])]


def removed_bytes(chunk: Chunk, contexts: Contexts, kind: np.ndarray, judged: dict[int, bytes], buckets: int) -> np.ndarray:
    """A mark on every byte of a chunk that goes."""
    marks = np.zeros(len(chunk.data) + 1, np.int32)
    plain = Plain(chunk, contexts, kind)
    first = plain.first[plain.of]
    later = (plain.id != plain.id[first]) | (plain.place != plain.place[first])
    np.add.at(marks, plain.start[later], 1)  # all strings of a later copy
    np.add.at(marks, (plain.start + plain.count + LENGTH - 1)[later], -1)
    twins: dict[int, list[int]] = {}  # rows that repeat an id may have the same context at the same place
    for k in np.flatnonzero(~later & (first != np.arange(len(first)))).tolist():
        twins.setdefault(int(first[k]), []).append(k)
    mine, edges = plain.by_bucket(buckets)
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        part = mine[edges[b] : edges[b + 1]]
        count = plain.count[part]
        offsets = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        bits = np.unpackbits(np.frombuffer(judged[2 * b], np.uint8), count=len(offsets)).astype(bool)
        starts = (np.repeat(plain.start[part], count) + offsets)[bits]
        if twins:
            owner, at = np.repeat(part, count)[bits], offsets[bits]
            for k in part.tolist():
                for twin in twins.get(k, ()):
                    starts = np.append(starts, plain.start[twin] + at[owner == k])
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + LENGTH, -1)
    hot = Hot(chunk, contexts, kind)
    if len(hot.of):
        order, edges = split_by(bucket_of(hot.hashes, buckets), buckets)
        repeated = np.zeros(len(order), bool)
        for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            part = order[edges[b] : edges[b + 1]]
            repeated[part] = np.unpackbits(np.frombuffer(judged[2 * b + 1], np.uint8), count=len(part))
        first = hot.first[hot.of]
        gone = repeated[hot.of] | (hot.id != hot.id[first]) | (hot.place != hot.place[first])
        np.add.at(marks, hot.start[gone], 1)
        np.add.at(marks, hot.start[gone] + LENGTH, -1)
    return np.cumsum(marks[:-1]) > 0


def compare_in_parts(strings: DataFrame, parts: int) -> DataFrame:
    """Answers about hot strings (bucket, chunk, payload) whose chunks are so many that a string in all of them would fill a group.

    Equal strings are made one within each of `parts` parts of the chunks, the
    earliest of all is found among those, and goes back to its part, where it is one
    more occurrence beside those of the chunks: so no group has a string more often
    than there are chunks in a part, or parts.
    """
    strings = strings.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))

    def combined(key: tuple, table: pa.Table) -> pa.Table:
        begin("exchange")
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "payload": pa.array([combined_hot(table.column("payload").to_pylist())], pa.binary())})

    def over_parts(table: pa.Table) -> pa.Table:
        begin("exchange")
        found = earliest_hot(table.column("payload").to_pylist())
        return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "payload": pa.array(found, pa.binary())})

    def compared(own: pa.Table, first: pa.Table) -> pa.Table:
        begin("exchange")
        answers = repeated_hot(own.column("payload").to_pylist() + first.column("payload").to_pylist())[: own.num_rows]
        return pa.table({"bucket": own.column("bucket"), "chunk": own.column("chunk"), "answer": pa.array(answers, pa.binary())})

    form = "bucket int, part long, payload binary"
    first = strings.groupBy("bucket", "part").applyInArrow(combined, form).groupBy("bucket").applyInArrow(over_parts, form)
    return strings.groupBy("bucket", "part").cogroup(first.groupBy("bucket", "part")).applyInArrow(compared, "bucket int, chunk long, answer binary")


def find_repeats(documents: DataFrame, hot: int, carry: list[str], parts: int | None = None) -> tuple[DataFrame, int]:
    """Chunks with the answers to both questions, and the number of buckets."""
    chunks = pack_chunks(documents, carry)
    size = text_bytes(documents)
    buckets = buckets_of(documents, size)
    parts = parts or -(-size // (CHUNK_BYTES * PART_CHUNKS))

    def anchors(row: dict) -> list[tuple[int, bytes]]:
        return [(b, hashes.tobytes() + counts.tobytes()) for b, hashes, counts in asked_anchors(Contexts(Chunk(row)), buckets)]

    def contexts(row: dict) -> list[tuple[int, bytes]]:
        chunk = Chunk(row)
        found = Contexts(chunk)
        return context_payloads(chunk, found, kinds(found, by_bucket(row["anchors"]), buckets), buckets)

    def judged(_: list[int], payloads: list[bytes]) -> list[bytes]:
        return repeated_anchors(payloads, hot)

    def compared(table: pa.Table) -> pa.Table:
        begin("exchange")
        payloads = table.column("payload").to_pylist()
        answers = repeated_hot(payloads) if table.column("bucket")[0].as_py() % 2 else repeated_strings(payloads)
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "answer": pa.array(answers, pa.binary())})

    known = chunks.join(answer(ask(chunks, anchors), judged, "anchors"), "chunk", "left")
    questions = ask(known, contexts)
    plain = questions if parts <= 1 else questions.filter("bucket % 2 = 0")
    replies = plain.groupBy("bucket").applyInArrow(compared, "bucket int, chunk long, answer binary")
    if parts > 1:
        replies = replies.unionByName(compare_in_parts(questions.filter("bucket % 2 = 1"), parts))
    strings = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("strings"))
    return known.join(strings, "chunk", "left"), buckets


def without_repeats(row: dict, buckets: int) -> list[tuple]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept for each document of a chunk's row."""
    chunk = Chunk(row)
    contexts = Contexts(chunk)
    gone = removed_bytes(chunk, contexts, kinds(contexts, by_bucket(row["anchors"]), buckets), by_bucket(row["strings"]), buckets)
    out = []
    for doc_id, begin, size in zip(chunk.ids.tolist(), chunk.begins.tolist(), chunk.sizes.tolist(), strict=True):
        mask = gone[begin : begin + size]
        removed = int(mask.sum())
        text = chunk.data[begin : begin + size]
        kept = (text[~mask] if removed else text).tobytes()
        spans = int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if removed else 0
        out.append((None if doc_id == NULL_ID else doc_id, size, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def remove_repeats(documents: DataFrame, hot: int = HOT, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every document."""
    chunks, buckets = find_repeats(documents, hot, [], parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = without_repeats(batch.slice(k, 1).to_pylist()[0], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return chunks.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def shortened_documents(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """All columns of every document, its text without repeated strings, and n_chars, if it has that column, to match.  A character that loses one of its bytes goes."""
    columns = documents.columns
    carry = [c for c in columns if c != "text"]
    chunks, buckets = find_repeats(documents, hot, carry)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("exchange")
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                texts = [r[-1].decode("utf-8", "ignore") for r in without_repeats(row, buckets)]
                rest = unstreamed(row["rest"])
                own = {"text": pa.array(texts, pa.string())}
                if "n_chars" in carry:
                    own["n_chars"] = pa.array([len(t) for t in texts], rest.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([own[c] if c in own else rest.column(rest.schema.get_field_index(c)) for c in columns], names=columns)

    return chunks.mapInArrow(cut, documents.schema)
