import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import decontamination, fm_index, packing, quality, token_counts
from tidemark.llm.bpe import Encoder, prefix_counts
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import table

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return Encoder(file.read())


def test_every_prefix_counts_as_if_encoded(library, encoder):
    for text in ["I'll don't\n\n  go  <|endoftext|> x'", " we've  \n \t a1b2 日本語!!'s", "<|endoftext|><|endo", "", "  ", "aaaaaaaaaaaaaaaaaaaa", "x　y\xa0 z"]:
        assert prefix_counts(encoder, text) == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_token_counts(documents, awkward, library, nothing):
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents, PATH).collect()}
    counts = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in awkward.items()}
    assert found == {i: (len((t or "").encode()), counts[i], counts[i] > 1024) for i, t in awkward.items()}
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_truncation(documents, awkward, library):
    for row in token_counts.truncate(documents.filter("doc_id IN (0, 5, 6, 18, 19)"), PATH, 7).collect():
        text = awkward[row.doc_id] or ""
        fitting = [k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 7]
        assert row.n_chars == max(fitting) and row.text == text[: max(fitting)] and row.n_tokens <= 7


def test_packing_round_trip(spark, documents, awkward, library, nothing):
    rows = packing.pack(documents, PATH, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    for doc_id, text in awkward.items():
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
        assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 for r in own)
        assert all(zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 for r in own)
    assert packing.pack(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents, PATH, longest=1000)


def test_binary_lengths():
    for n in range(1, 3000, 7):
        lengths = packing.binary_lengths(n, 1024)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and all(x & (x - 1) == 0 and x <= 1024 for x in lengths)


def test_statistics_match_brute_force(documents, awkward, nothing):
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(documents).collect()}
    assert found == {i: brute.statistics(t) for i, t in awkward.items()}
    assert quality.text_statistics(nothing).count() == 0


def test_decision_list_learns_a_threshold(spark):
    rng = random.Random(1)
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        levels = {n: rng.randint(0, 1000) for n in quality.levels()}
        levels["symbols"] = rng.randint(300, 900) if bad else rng.randint(0, 200)
        rows.append((int(bad), k % 3, *levels.values()))
    frame = spark.createDataFrame(rows, "reject int, fold int, " + ", ".join(f"{n} int" for n in quality.levels()))
    rules = quality.learn(frame)
    assert [c.name for rule in rules for c in rule] == ["symbols"] and 200 < rules[0][0].limit <= 300
    assert frame.filter(quality.verdict(rules)).filter("reject = 1").count() == 0
    assert quality.learn(frame.filter("reject = 0")) == [] and quality.learn(frame.limit(0)) == []


def test_verdicts_without_labels(spark, documents, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_verdicts(documents, labels).collect()}
    assert set(out) == set(awkward) and all(kept != failed for failed, kept in out.values())


def test_verdicts_agree_with_labels(spark, sf_dir):
    verdicts = {r.doc_id: r for r in QUERIES["op8_decision_list"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels").collect()
    judged = [(verdicts[r.doc_id].kept, r.quality == 1) for r in labels if not verdicts[r.doc_id].base_failed]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_index_finds_every_occurrence():
    rng = random.Random(2)
    text = [rng.randint(1, 5) for _ in range(800)] + [1, 2] * 100
    index = fm_index.FMIndex(np.array(text), 5)
    patterns = [tuple(text[k : k + w]) for k in range(0, 900, 17) for w in (1, 3, 13)] + [(5, 5, 5, 5, 5, 5, 5, 5)]
    grid = np.zeros((len(patterns), 13), np.int64)
    for k, p in enumerate(patterns):
        grid[k, : len(p)] = p
    low, high = index.ranges(grid, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert found == [k for k in range(len(text) - len(p) + 1) if tuple(text[k : k + len(p)]) == p]


@pytest.mark.parametrize("block", [decontamination.BLOCK_BYTES, 300])
def test_contamination_matches_brute_force(spark, documents, awkward, nothing, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = {"1": awkward[6][50:300], "10": "ONE two", "2": None, "3": "...", "4": awkward[9][200:420], "5": "ba " * 20, "6": awkward[6][50:300], None: awkward[20][100:300]}
    benchmark = spark.createDataFrame([*items.items()], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(documents, benchmark).collect()}
    assert found == brute.contamination(awkward, items)
    clashing = documents.withColumns({"_found_n_hit": F.lit(1), "_searched": F.lit("x")})
    assert decontamination.clean_documents(clashing, benchmark).columns == clashing.columns
    twice = decontamination.contamination(documents.union(documents), benchmark).groupBy("doc_id").count()
    assert twice.filter("count <> 2").count() == 0
    kept = decontamination.clean_documents(documents, benchmark)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, row in found.items() if not row[-1]}
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert decontamination.contamination(documents, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_words_by_two_libraries(spark, library):
    """Single words merged by tiktoken and by tokenizers, over the table's words and odd texts."""
    with open(PATH, encoding="utf-8") as file:
        vocabulary = file.read()
    engine, rng = packing.word_engine(vocabulary), random.Random(7)
    words = {w for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() for w in (r.text or "").split(" ") if w}
    odd = ["".join(chr(rng.choice([rng.randrange(33, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    for word in [*sorted(words)[:20_000], *odd]:
        if packing.spaced_apart(word):
            assert engine(" " + word) == library.encode(" " + word, add_special_tokens=False).ids, word


def test_prefixes_around_added_tokens(library, encoder):
    text = "word " * 30 + "end<|endoftext|>  then <|endoftext|><|endoftext|> x <|endof"
    assert prefix_counts(encoder, text) == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_labels_out_of_their_domain(spark, documents):
    labels = spark.createDataFrame([(i, 2) for i in range(21)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = quality.quality_verdicts(documents, labels).collect()
    assert len(out) == 21 and all(r.kept != r.base_failed for r in out)


def verdict_by_brute_force(levels, rules):
    for rule in rules:
        if all(levels[c.name] >= c.limit if c.least else levels[c.name] <= c.limit for c in rule):
            return False
    return True


def test_verdicts_match_brute_force(spark):
    rng = random.Random(12)
    names = list(quality.levels())
    rows = [tuple(rng.randint(0, 1000) for _ in names) for _ in range(300)]
    rules = [tuple(quality.Condition(rng.choice(names), rng.random() < 0.5, rng.randint(0, 1000)) for _ in range(rng.randint(1, 3))) for _ in range(5)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    for row in frame.withColumn("kept", quality.verdict(rules)).collect():
        assert row.kept == verdict_by_brute_force(row.asDict(), rules)


def test_a_prefix_s_last_token_is_looked_for_within_bounds():
    import public_tokenizers

    from tidemark.llm.bpe import ENDING, Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    reach = lambda word: encoder.longest.get(word[-ENDING:], ENDING - 1)
    assert all(reach(word) >= len(word) for word in encoder.ids)
    assert reach(b" qqqq") == ENDING - 1
    for text in ("a", " of", "internationalisation", "éé ütf", " 0123456789" * 9, "aaaaaaaaaaaaaaaaaaaaaaa", "\n\n\n\t x"):
        assert encoder.count(text) == len(encoder.library.encode(text, add_special_tokens=False).ids)
