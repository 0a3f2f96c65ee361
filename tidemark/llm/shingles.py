"""Sets of word shingles, as 64-bit hashes, for all documents of a chunk at a time; and as they are, for a text."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .exchange import Chunk
from .suffix_dedup import mixed

WIDTH = 5
#: Words of more bytes are hashed one by one.
LONG_WORD = 512
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros past the end."""
    count = len(data) // 8 + 2
    padded = np.zeros(8 * count + 8, np.uint8)
    padded[: len(data)] = data
    out = np.empty(8 * count, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + 8 * count].view("<u8")
    return out


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and its document, in order.  Eight bytes at a time are mixed in, so that no sum or product of bytes makes words alike."""
    data = LOWER[chunk.data]
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a document begins
    edge[chunk.begins] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(begins)
    ending = inside.copy()
    ending[:-1] &= ~inside[1:] | edge[1:n]
    lengths = np.flatnonzero(ending) + 1 - starts
    lanes = eight_bytes(data)
    hashes = mixed(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    open_ = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(open_):
        left = np.minimum(lengths[open_] - at, 8).astype(np.uint64)
        lane = lanes[starts[open_] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        hashes[open_] = mixed((hashes[open_] ^ lane) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at))
        at += 8
        open_ = open_[lengths[open_] > at]
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        word = data[starts[k] : starts[k] + lengths[k]].tobytes()
        hashes[k] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64)[0]
    document = np.searchsorted(np.cumsum(chunk.sizes), starts, side="right")
    return hashes, document


def multipliers(seed: int) -> np.ndarray:
    return mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def shingle_sets(chunk: Chunk) -> list[np.ndarray]:
    """By document the sorted distinct hashes of its WIDTH-word shingles; of the whole sequence if it has fewer words; none without words."""
    words, document = word_hashes(chunk)
    edges = np.searchsorted(document, np.arange(len(chunk.sizes) + 1))
    weights = multipliers(0xD6E8FEB86659FD93)
    n = len(words) - WIDTH + 1
    rolled = mixed(sum((words[k : k + n] * weights[k] for k in range(WIDTH)), np.zeros(n, np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        count = end - begin
        if count >= WIDTH:
            out.append(np.unique(rolled[begin : end - WIDTH + 1]))
        elif count:
            out.append(mixed((words[begin:end] * weights[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles_of(text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = WORD.findall(text.lower())  # of bytes: A to Z alone
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False)) if len(words) >= WIDTH else {tuple(words)} if words else set()
