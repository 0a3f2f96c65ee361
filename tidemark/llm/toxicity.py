"""Toxicity of texts whose words may be disguised.

1. A character trigram model is counted over all words of all documents.
2. Words are restored under it (`noisy_channel`).
3. From labelled rows of the training folds a lexicon is learned.  Its entries are
   words and word beginnings, each with a level of strength: how often a text has it
   for its length.  Taken are those that toxic texts have so much more often than
   clean ones that chance can't explain it, however many entries are looked at.
   Near copies of a text count once.  An entry that clean texts have too has to
   explain toxic texts that purer entries leave unexplained.
4. A text scores the share of toxic texts among those that have its worst entry;
   a text without any scores the share among those that have none.

The classifier is fitted on a sample of labelled rows of bounded expected size,
TOXIC_ROWS and CLEAN_ROWS of at most SAMPLE_BYTES each, chosen by a hash of the id;
all else covers all data.

Defined cases: a null or empty text has no words; texts and words of any length
count whole; without labelled rows of both kinds all texts score 0; equal rows give
equal rows; labels other than 0 and 1, and null ids of labels, are not learned from;
of several labels of one id the least counts; other columns, also lang and source,
aren't read, and may have any names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Container, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .noisy_channel import Model, joins, plain_word, spelt_out, trigrams
from .tables import checkpointed, parallelism, small_batches, spare_name
from .worker import Cache, begin, kept

TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 6_000, 24_000, 256 << 20
#: Purity from which an entry is taken whatever others explain.
PURE = 0.95
#: Letters of a word's beginning that make an entry; highest level of strength.
SHORTEST, LONGEST, STRONGEST = 3, 8, 5
#: Words of a text for which one occurrence has strength 1.
PER_WORDS = 256
SKETCHES = 6
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def letter_model(documents: DataFrame) -> dict[str, int]:
    """Trigram counts over all words of all documents; their number is bounded by the model's alphabet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        grams = trigrams(text or "" for batch in batches for text in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])

    rows = documents.select("text").mapInArrow(counted, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {gram: n for gram, n in rows.collect()}


def stems(word: str) -> list[str]:
    """A word, and what it begins with (with a star)."""
    return [word, *(word[:k] + "*" for k in range(SHORTEST, min(LONGEST + 1, len(word))))]


def level(count: int, words: int) -> int:
    """The strength of an entry that a text of so many words has `count` times: its power of two, STRONGEST at most; 0 for any presence.

    Strength grows faster than the share of words, so that one chance occurrence in a
    short text doesn't weigh as much as several in a longer one.
    """
    strength = count * math.sqrt(count) * PER_WORDS / words
    return min(STRONGEST, int(math.log2(strength))) if strength >= 2 else 0


def stem_counts(text: str, of_token: Callable[[str], Sequence[str]], of_word: Callable[[str], Sequence[str]], model: Model) -> tuple[Counter[str], int]:
    """How often a text has each stem that is asked for in its restored words, and its number of words."""
    lower = text.lower()
    tokens = Counter(lower.split())
    counts: Counter[str] = Counter()
    for token, n in tokens.items():
        for stem in of_token(token):
            counts[stem] += n
    for word in spelt_out(lower, model):
        counts.update(of_word(word))
    return counts, max(1, tokens.total())


def sketches(text: str) -> list[int]:
    """Minima of checksums of three words in a row; near copies share some, other texts hardly any."""
    words = text.lower().split()
    if len(words) < 3:
        return [zlib.crc32(f"{k} {' '.join(words)}".encode()) for k in range(SKETCHES)]
    hashes = [zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(len(words) - 2)]
    return [min((h * (2 * k + 3) ^ (h >> k)) & 0xFFFFFFFF for h in hashes) for k in range(SKETCHES)]


def families(rows: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """(text, family) where texts that share a sketch are of one family."""
    parent = {key: key for key, _ in rows}

    def root(key: int) -> int:
        while parent[key] != key:
            parent[key] = key = parent[parent[key]]
        return key

    first: dict[tuple[int, int], int] = {}
    for key, values in rows:
        for pair in enumerate(values):
            parent[root(key)] = root(first.setdefault(pair, key))
    return [(key, root(key)) for key in parent]


def sampled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of labelled rows outside fold 0: about TOXIC_ROWS and CLEAN_ROWS of them, and about SAMPLE_BYTES of text for each at most."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"))
    counts = {row[0]: row[1] for row in usable.groupBy("toxic").count().collect()}
    average = documents.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))

    def share(toxic: int, rows: int) -> float:
        return min(1.0, min(rows, SAMPLE_BYTES / average) / max(1, counts.get(toxic, 0)))

    chosen = usable.filter(place <= F.when(F.col("toxic") == 1, share(1, TOXIC_ROWS)).otherwise(share(0, CLEAN_ROWS)))
    # TOXIC_ROWS + CLEAN_ROWS rows of 12 bytes, about
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # read several times; wherever they stood, all tasks get some
    return checkpointed(rows.repartition(parallelism(documents.sparkSession)))


def letters_of(model: Broadcast) -> tuple[Model, str]:
    """The model that a worker keeps, and its name."""
    begin("toxicity")
    name = f"letters_{len(model.value)}_{sum(model.value.values())}_{zlib.crc32(repr(sorted(model.value.items())).encode())}"
    return kept(name, lambda: Model(model.value)), name


def toxic_entries(rows: DataFrame, model: Broadcast) -> DataFrame:
    """By toxic text its checksum, sketches and stems, each with its level."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, _ = letters_of(model)

        def entries(text: str) -> list[dict]:
            counts, total = stem_counts(text, lambda token: stems(plain_word(token, letters)), stems, letters)
            return [{"stem": stem, "level": level(n, total)} for stem, n in counts.items()]

        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            keys = [zlib.crc32(x.encode()) << 20 | len(x) & 0xFFFFF for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(map(sketches, texts), pa.list_(pa.int64())), pa.array(map(entries, texts), pa.list_(pa.struct([("stem", pa.string()), ("level", pa.int32())])))], names=["text", "sketches", "entries"])

    return rows.filter("toxic = 1").select("text").mapInArrow(found, "text long, sketches array<long>, entries array<struct<stem:string,level:int>>")


def clean_counts(rows: DataFrame, model: Broadcast, candidates: Broadcast) -> DataFrame:
    """entry and number of clean texts that have it, for candidates."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, _ = letters_of(model)
        levels: dict[str, list[int]] = {}
        for entry in candidates.value:
            stem, at = entry.rsplit(" ", 1)
            levels.setdefault(stem, []).append(int(at))
        asked = Asked(levels, letters)
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts, total = stem_counts(text or "", asked.tokens.__getitem__, asked.of_word, letters)
                for stem, n in counts.items():
                    at = level(n, total)
                    for k in levels[stem]:
                        if k <= at:
                            found[stem, k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{stem} {k}" for stem, k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["entry", "n"])

    return rows.filter("toxic = 0").select("text").mapInArrow(counted, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


class Asked:
    """Finds the stems of a given set that a word has."""

    def __init__(self, known: Container[str], model: Model) -> None:
        self.known = known
        self.beginnings = {stem.rstrip("*")[:SHORTEST] for stem in known}
        self.tokens = Cache(lambda token: self.of_word(plain_word(token, model)))

    def of_word(self, word: str) -> tuple[str, ...]:
        if word[:SHORTEST] not in self.beginnings:
            return ()
        return tuple(stem for stem in stems(word) if stem in self.known)


def log_ratio(n: int, toxic: int, other: int, clean: int) -> float:
    """Twice the log-likelihood ratio of an entry's two rates against one common rate."""

    def likelihood(k: int, total: int, rate: float) -> float:
        return (k * math.log(rate) if k else 0.0) + ((total - k) * math.log(1 - rate) if total > k else 0.0)

    rate = (n + other) / (toxic + clean)
    return 2 * (likelihood(n, toxic, n / toxic) + likelihood(other, clean, other / clean) - likelihood(n, toxic, rate) - likelihood(other, clean, rate))


def least_support(toxic: int, clean: int, ratio: float) -> int:
    """Toxic texts without which no entry reaches the ratio, even if no clean text has it."""
    return next((n for n in range(2, toxic + 1) if log_ratio(n, toxic, 0, clean) >= ratio), toxic + 1)


def learn(rows: DataFrame, model: Broadcast) -> tuple[dict[str, float], float]:
    """The lexicon with the share of toxic texts for each entry, and that of texts without any.

    What reaches the driver is bounded by the sample: a number for each text, the
    entries that enough of its toxic texts share, and which of them have the telling ones.
    """
    spark = rows.sparkSession
    clean = rows.filter("toxic = 0").count()
    texts = checkpointed(toxic_entries(rows, model).dropDuplicates(["text"]))
    sketched = [(row[0], row[1]) for row in texts.select("text", "sketches").collect()]  # TOXIC_ROWS rows, about
    if not sketched or not clean:
        return {}, 0.0
    family = spark.createDataFrame(families(sketched), "text long, family long")
    toxic = family.select("family").distinct().count()
    pairs = texts.select("text", F.explode("entries").alias("e")).join(F.broadcast(family), "text")
    seen = checkpointed(pairs.groupBy("e.stem", "family").agg(F.max("e.level").alias("level")))
    by_level = [F.count_if(F.col("level") >= k).alias(f"n{k}") for k in range(STRONGEST + 1)]
    counted = checkpointed(seen.groupBy("stem").agg(*by_level).filter("n0 > 1"))
    # so great that of this many entries hardly one reaches it by chance
    looked_at = counted.agg(*(F.count_if(F.col(f"n{k}") > 1) for k in range(STRONGEST + 1))).first()
    ratio = 2 * math.log(sum(looked_at) + 1) + 2
    least = least_support(toxic, clean, ratio)
    rows_of = counted.filter(F.col("n0") >= least).collect()
    counts = {f"{row[0]} {k}": row[k + 1] for row in rows_of for k in range(STRONGEST + 1) if row[k + 1] >= least}
    other = dict(clean_counts(rows, model, spark.sparkContext.broadcast(frozenset(counts))).collect())

    def share(n: int, entry: str) -> float:
        return (n + 0.5) / (n + other.get(entry, 0) + 1)

    telling = {e for e, n in counts.items() if n / toxic > other.get(e, 0) / clean and share(n, e) >= 0.5 and log_ratio(n, toxic, other.get(e, 0), clean) >= ratio}
    if not telling:
        return {}, min(0.4, toxic / (toxic + clean))
    chosen = spark.createDataFrame(sorted({(e.rsplit(" ", 1)[0],) for e in telling}), "stem string")  # some of the stems collected above
    having: dict[str, set[int]] = {}
    for stem, member, at in seen.join(F.broadcast(chosen), "stem").select("stem", "family", "level").collect():
        for k in range(at + 1):
            if f"{stem} {k}" in telling:
                having.setdefault(f"{stem} {k}", set()).add(member)
    lexicon: dict[str, float] = {}
    explained: set[int] = set()
    for entry in sorted(having, key=lambda e: (-share(len(having[e]), e), -len(having[e]), e)):
        value = share(len(having[entry]), entry)
        if value < PURE:
            value = share(len(having[entry] - explained), entry)
        if value > 0.5:
            lexicon[entry] = value
            explained |= having[entry]
    left = toxic - len(explained)
    return lexicon, min(0.4, (left + 0.5) / (left + clean + 1))


class Scorer:
    """Scores texts by a learned lexicon."""

    def __init__(self, lexicon: dict[str, float], without: float, model: Model) -> None:
        self.without, self.model = without, model
        # by stem the worst share at each level or below it
        self.worst: dict[str, list[float]] = {}
        for entry, value in lexicon.items():
            stem, at = entry.rsplit(" ", 1)
            values = self.worst.setdefault(stem, [without] * (STRONGEST + 1))
            for k in range(int(at), STRONGEST + 1):
                values[k] = max(values[k], value)
        self.asked = Asked(self.worst, model)
        # how a word of the lexicon may be split in two
        self.splits: dict[str, set[str]] = {}
        for stem in self.worst:
            if not stem.endswith("*") and stem.isalpha():
                for k in range(2, len(stem) - 1):
                    self.splits.setdefault(stem[:k], set()).add(stem[k:])

    def split_words(self, lower: str, tokens: set[str]) -> list[str]:
        """Words of the lexicon whose two parts follow each other in a text, where the model joins them."""
        out = []
        for first in self.splits.keys() & tokens:
            for second in self.splits[first] & tokens:
                n = len(re.findall(rf"(?<!\S){re.escape(first)}\s+(?={re.escape(second)}(?!\S))", lower))
                if n and joins(first, second, self.model):
                    out += [first + second] * n
        return out

    def score(self, text: str) -> float:
        counts, total = stem_counts(text, self.asked.tokens.__getitem__, self.asked.of_word, self.model)
        if self.splits:
            lower = text.lower()
            for word in self.split_words(lower, set(lower.split())):
                counts.update(self.asked.of_word(word))
        return max((self.worst[stem][level(n, total)] for stem, n in counts.items()), default=self.without)


def score_texts(documents: DataFrame, labels: DataFrame, carry: list[str], name: str = "score") -> DataFrame:
    """The columns `carry` of every document, and its score in column `name`, which none of them may have."""
    context = small_batches(documents).sparkSession.sparkContext
    model = context.broadcast(letter_model(documents))
    lexicon, without = learn(sampled(documents, labels), model)
    learned = context.broadcast((lexicon, without))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, name = letters_of(model)
        scorer = kept(f"scorer_{name}_{zlib.crc32(repr(sorted(learned.value[0].items())).encode())}_{learned.value[1]}", lambda: Scorer(*learned.value, letters))
        for batch in batches:
            scores = [scorer.score(text or "") for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*carry, name])

    schema = T.StructType([*(documents.schema[c] for c in carry), T.StructField(name, T.DoubleType())])
    return documents.select(F.col("text").alias(spare_name("text", carry)), *carry).mapInArrow(scored, schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (fold 0), score and predicted (score of 0.5 or more) for every document."""
    scored = score_texts(documents, labels, ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, all their columns."""
    name = spare_name("score", documents.columns)
    return score_texts(documents, labels, documents.columns, name).filter(F.col(name) < 0.5).select(*documents.columns)
