"""Languages of words, and of texts, by a linear-chain conditional random field.

A word's features are its beginnings and ends, the character pairs and triples in
it, and itself if it belongs to the lexicon; each has a weight for each language,
and each pair of languages a weight for following each other.  The forward and
backward messages give every word's probabilities; a text's language is the one
with the greatest sum of them, its score that language's share.

The model is fitted on the driver on a bounded sample: of each language (of the
MOST_LANGUAGES with most documents) about SAMPLE_BYTES of texts of SAMPLE_TEXT bytes
at most.  Texts are labelled as wholes, so training sequences are strings of short
spans from the sample in random order, in which languages change.

Words are shared by many texts, so a worker keeps their weights in bounded memory.
Messages are exact for texts of any length: a text is cut into blocks, whose products of
transition matrices are formed side by side, then joined in order, and then the
messages run inside all blocks side by side.

Defined cases: words are runs of letters, in lower case.  A text that is null or has no letter
is `und` with score 0, so is every text where no row can be learned from.  Texts
are labelled whole; equal rows give equal rows; ties go to the language that sorts
first; rows without text or language aren't learned from; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_batches
from .worker import Cache, begin, kept

SAMPLE_BYTES, SAMPLE_TEXT, MOST_LANGUAGES = 1 << 19, 1 << 16, 64
#: Letters of the longest affix; distinct words that a feature needs, occurrences that a word of the lexicon needs.
AFFIX, FEATURE_WORDS, LEXICON_WORDS = 4, 2, 3
#: Words of a span, of a training sequence; sequences of a step; rounds; step width; decay of weights by step.
SPAN, SEQUENCE, STEP, ROUNDS, RATE, DECAY = (3, 30), 64, 192, 5, 0.4, 1e-4
#: Bytes of text labelled together, about; words of a block; bytes of what is known of words.
CHUNK_BYTES, BLOCK, WORDS_BYTES = 1 << 20, 32, 64 << 20
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def words_of(text: str) -> list[str]:
    """Runs of letters; a run of other signs that count as alphanumeric is no word, but is left in here for speed."""
    return WORD.findall(text.lower())


def is_word(run: str) -> bool:
    return any(map(str.isalpha, run))


def features(word: str) -> list[str]:
    """The word, its affixes and its pairs and triples; < and > stand at its ends."""
    spelt = f"<{word}>"
    count = len(spelt)
    found = ["=" + word, *(spelt[:k] for k in range(2, min(AFFIX + 2, count))), *(spelt[-k:] for k in range(2, min(AFFIX + 2, count)))]
    found += [spelt[k : k + n] for n in (2, 3) for k in range(count - n + 1)]
    return list(dict.fromkeys(found))


@dataclass
class Model:
    """languages in order; rows of `weights` by feature; the weight of each language after each."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def factors(self, words: list[str]) -> list[bytes]:
        """By word its factors by language, the greatest 1; nothing if it is no word."""
        known = [[k for k in map(self.index.get, features(w)) if k is not None] if is_word(w) else None for w in words]
        sizes = np.array([0 if x is None else len(x) for x in known], np.int64)
        rows = np.fromiter((k for x in known if x for k in x), np.int64, int(sizes.sum()))
        sums = np.zeros((len(words), len(self.languages)))
        if len(rows):
            sums[sizes > 0] = np.add.reduceat(self.weights[rows].astype(np.float64), (np.cumsum(sizes) - sizes)[sizes > 0])
        data, width = np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -60.0)).tobytes(), 8 * len(self.languages)
        return [b"" if x is None else data[k * width : (k + 1) * width] for k, x in enumerate(known)]


def sample(documents: DataFrame, usable: Column) -> list[tuple[str, str]]:
    """lang and text of a bounded sample of the rows that may be learned from."""
    rows = documents.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter(usable & F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT))
    by_language = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    sizes = by_language.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col("lang") == row["lang"], min(1.0, SAMPLE_BYTES / max(1, row["size"]))).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))
    chosen = small_batches(rows).filter(place < share).select("lang", "text").collect()  # MOST_LANGUAGES times SAMPLE_BYTES, about
    return sorted((row["lang"], row["text"]) for row in chosen)


def sequences(rows: list[tuple[str, str]], languages: list[str], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The vocabulary, and words and languages of sequences made of spans in random order."""
    number, spans = {}, []
    for lang, text in rows:
        words = [number.setdefault(w, len(number)) for w in words_of(text) if is_word(w)]
        at = 0
        while at < len(words):
            end = at + int(rng.integers(*SPAN))
            spans.append((languages.index(lang), words[at:end]))
            at = end
    order = rng.permutation(len(spans))
    flat = np.array([w for k in order for w in spans[k][1]], np.int64)
    labels = np.array([spans[k][0] for k in order for _ in spans[k][1]], np.int64)
    count = len(flat) // SEQUENCE
    if not count and len(flat):  # one short sequence
        return list(number), flat[None, :], labels[None, :]
    return list(number), flat[: count * SEQUENCE].reshape(count, SEQUENCE), labels[: count * SEQUENCE].reshape(count, SEQUENCE)


def expected(factors: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By sequence and word the probabilities of languages, and the sum of those of neighbours."""
    count, length, kinds = factors.shape
    forward, backward = np.empty_like(factors), np.ones_like(factors)
    a = factors[:, 0]
    forward[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (forward[:, t - 1] @ steps) * factors[:, t]
        forward[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        b = (backward[:, t + 1] * factors[:, t + 1]) @ steps.T
        backward[:, t] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    neighbours = np.zeros((kinds, kinds))
    for t in range(1, length):
        pair = forward[:, t - 1, :, None] * steps * (factors[:, t] * backward[:, t])[:, None, :]
        neighbours += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both / both.sum(axis=2, keepdims=True), neighbours


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Model:
    """By stochastic ascent of the likelihood with a step width for each weight."""
    languages = sorted({lang for lang, text in rows if any(map(is_word, words_of(text)))})
    rng, kinds = np.random.default_rng(seed), len(languages)
    vocabulary, words, labels = sequences([r for r in rows if r[0] in languages], languages, rng)
    occurrences = np.bincount(words.ravel(), minlength=len(vocabulary)) if words.size else []
    listed = [features(w) if n >= LEXICON_WORDS else features(w)[1:] for w, n in zip(vocabulary, occurrences, strict=True)]
    in_words = Counter(f for fs in listed for f in fs)
    index = {f: k for k, f in enumerate(f for f, n in in_words.items() if n >= FEATURE_WORDS or f[0] == "=")}
    own = [[index[f] for f in fs if f in index] + [len(index)] for fs in listed]  # the last feature has no weight, so that no word is without
    first = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
    flat = np.array([k for x in own for k in x], np.int64)
    weights, transitions = np.zeros((len(index) + 1, kinds)), np.zeros((kinds, kinds))
    squares, step_squares = np.full(weights.shape, 1e-6), np.full(transitions.shape, 1e-6)
    for _ in range(ROUNDS if words.size else 0):
        order = rng.permutation(len(words))
        for at in range(0, len(order), STEP):
            batch = order[at : at + STEP]
            here, place = np.unique(words[batch], return_inverse=True)
            sizes = first[here + 1] - first[here]
            begins = np.cumsum(sizes) - sizes
            used = flat[np.arange(sizes.sum()) - np.repeat(begins, sizes) + np.repeat(first[here], sizes)]
            sums = np.add.reduceat(weights[used], begins)
            place = place.reshape(words[batch].shape)
            factors = np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -60.0))[place]
            found, neighbours = expected(factors, np.exp(transitions))
            known = np.eye(kinds)[labels[batch]]
            miss = (known - found).reshape(-1, kinds)
            by_word = np.stack([np.bincount(place.ravel(), miss[:, k], len(here)) for k in range(kinds)], axis=1)
            touched, back = np.unique(used, return_inverse=True)
            slope = np.stack([np.bincount(back, np.repeat(by_word[:, k], sizes), len(touched)) for k in range(kinds)], axis=1)
            squares[touched] += slope * slope
            weights[touched] += RATE * slope / np.sqrt(squares[touched]) - DECAY * weights[touched]
            weights[-1] = 0.0
            pairs = np.einsum("qti,qtj->ij", known[:, :-1], known[:, 1:]) - neighbours
            step_squares += pairs * pairs
            transitions += RATE * pairs / np.sqrt(step_squares)
    return Model(languages, index, weights[:-1].astype(np.float32), transitions)


def probabilities(factors: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """By word its probabilities; `factors` of all words of all texts, `sizes` (1 at least) the words of each text, `steps` the factors of neighbours."""
    kinds = len(steps)
    if not len(factors):
        return np.zeros((0, kinds))
    blocks_of = -(-sizes // BLOCK)
    ends = np.cumsum(blocks_of)
    begins, count = ends - blocks_of, int(ends[-1])
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(factors)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    block, place = begins[text] + inside // BLOCK, inside % BLOCK
    laid = np.ones((BLOCK, count, kinds))
    laid[place, block] = factors
    filled = np.zeros((BLOCK, count), bool)
    filled[place, block] = True
    opening = np.zeros(count, bool)
    opening[begins] = True

    def scaled(x: np.ndarray, axes: int | tuple[int, ...]) -> np.ndarray:
        return x / x.max(axis=axes, keepdims=True)

    def ahead(x: np.ndarray, s: int) -> np.ndarray:
        """Messages to the words at place s of all blocks; a text's first word has none before it, and past its last nothing changes."""
        shape = (-1, *[1] * (x.ndim - 1))
        moved = x @ steps
        if not s:
            moved = np.where(opening.reshape(shape), x, moved)
        moved = moved * (laid[s][:, None] if x.ndim == 3 else laid[s])
        return scaled(moved if filled[s].all() else np.where(filled[s].reshape(shape), moved, x), tuple(range(1, x.ndim)))

    products = np.broadcast_to(np.eye(kinds), (count, kinds, kinds))
    for s in range(BLOCK):
        products = ahead(products, s)
    entering, leaving = np.ones((count, kinds)), np.ones((count, kinds))
    for r in range(1, int(blocks_of.max())):
        now = begins[blocks_of > r] + r
        entering[now] = scaled(np.einsum("ki,kij->kj", entering[now - 1], products[now - 1]), 1)
        now = ends[blocks_of > r] - 1 - r
        leaving[now] = scaled(np.einsum("kij,kj->ki", products[now + 1], leaving[now + 1]), 1)
    forward = np.empty_like(laid)
    message = entering
    for s in range(BLOCK):
        message = forward[s] = ahead(message, s)
    message = leaving
    for s in range(BLOCK - 1, -1, -1):
        forward[s] *= message
        message = scaled(np.where(filled[s][:, None], (message * laid[s]) @ steps.T, message), 1)
    both = forward[place, block]
    return both / both.sum(axis=1, keepdims=True)


def labelled(model: Model, known: Cache, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words by text, their numbers, and the probabilities of all."""
    local: dict[str, int] = {}
    runs = [words_of(text) for text in texts]
    coded = [[local.setdefault(w, len(local)) for w in words] for words in runs]
    found = {w: known[w] for w in local if w in known or w in known.older}
    new = [w for w in local if w not in found]
    found |= zip(new, model.factors(new), strict=True)
    known.function = found.__getitem__
    factors = [known[w] for w in local]
    is_one = np.array([bool(x) for x in factors], bool)
    sizes = np.array(list(map(len, coded)), np.int64)
    at = np.fromiter((k for x in coded for k in x), np.int64, int(sizes.sum()))
    if not is_one.all():
        stays = is_one[at]
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[stays], minlength=len(texts))
        at, runs = at[stays], [[w for w in words if is_one[local[w]]] for words in runs]
    table = np.frombuffer(b"".join(factors), np.float64).reshape(-1, len(model.languages))
    rows = (np.cumsum(is_one) - 1)[at]
    return runs, sizes, probabilities(table[rows], sizes[sizes > 0], np.exp(model.transitions))


def by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)))
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def in_chunks(model: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a chunk (doc_id and what stands beside it), then what `labelled` has of their texts, which are the last column."""
    begin("language_crf")
    fitted = Model(*model.value)
    known = kept(f"words_{hashlib.md5(fitted.weights.tobytes()).hexdigest()}", lambda: Cache(str, WORDS_BYTES))
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_BYTES or k == len(texts) - 1:
                yield batch.slice(at, k + 1 - at), *labelled(fitted, known, texts[at : k + 1])
                at, size = k + 1, 0


def model_of(documents: DataFrame, usable: Column) -> Broadcast | None:
    """What is learned from the rows of `documents` (doc_id, text, lang) for which `usable` holds; None if nothing can be."""
    model = fit(sample(documents, usable))
    return documents.sparkSession.sparkContext.broadcast((model.languages, model.index, model.weights, model.transitions)) if model.languages else None  # as large as the sample's features


def word_languages(documents: DataFrame, model: Broadcast) -> DataFrame:
    """doc_id, place (from 0), word, lang and score: every word's likeliest language and its probability."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, sizes, found in in_chunks(model, batches):
            languages = pa.array(model.value[0], pa.string())
            text = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [rows.column(0).take(pa.array(text)), pa.array(place, pa.int64()), pa.array([w for x in words for w in x], pa.string()), languages.take(pa.array(found.argmax(axis=1))), pa.array(found.max(axis=1) if len(found) else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "word", "lang", "score"])

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(named, "doc_id long, place long, word string, lang string, score double")


def text_languages(documents: DataFrame, usable: Column) -> DataFrame:
    """doc_id, lang_pred and score for every document, by a model of those for which `usable` holds."""
    model = model_of(documents, usable)
    rows = small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, sizes, found in in_chunks(model, batches):
            sums = by_text(found, sizes)
            languages = pa.array([*model.value[0], UNKNOWN], pa.string())
            best = np.where(sizes > 0, sums.argmax(axis=1), len(languages) - 1)
            score = np.clip(sums.max(axis=1) / np.maximum(sizes, 1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([chunk.column(0), languages.take(pa.array(best)), pa.array(np.where(sizes > 0, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(judged, "doc_id long, lang_pred string, score double")


def document_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out (fold 1 of three, not learned from), lang_pred and score."""
    return text_languages(documents, F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
