import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_crf
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import table

SF = "/root/testdata/sf0.01"


def brute(factors, steps):
    """Probabilities by adding up all paths."""
    count, kinds = factors.shape
    out = np.zeros((count, kinds))
    for path in itertools.product(range(kinds), repeat=count):
        weight = math.prod(factors[t, k] for t, k in enumerate(path)) * math.prod(steps[a, b] for a, b in itertools.pairwise(path))
        for t, k in enumerate(path):
            out[t, k] += weight
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_messages_equal_all_paths(monkeypatch, block):
    monkeypatch.setattr(language_crf, "BLOCK", block)
    rng = np.random.default_rng(1)
    steps = np.exp(rng.normal(0, 2, (3, 3)))
    sizes = np.array([1, 7, 2, 5, 1, 6])
    factors = np.exp(rng.normal(0, 2, (sizes.sum(), 3)))
    wanted = np.concatenate([brute(part, steps) for part in np.split(factors, np.cumsum(sizes)[:-1])])
    assert np.allclose(language_crf.probabilities(factors, sizes, steps), wanted)
    same = np.split(factors, [1])[1][:7][None]
    found, neighbours = language_crf.expected(same, steps)
    assert np.allclose(found[0], wanted[1:8]) and neighbours.sum() == pytest.approx(6)


def test_long_texts_keep_their_scale():
    steps = np.array([[1.0, 1e-8], [1e-8, 1.0]])
    factors = np.tile([[1.0, 1e-20]], (100_000, 1))
    factors[60_000:] = [1e-20, 1.0]
    found = language_crf.probabilities(factors, np.array([100_000]), steps)
    assert np.isfinite(found).all() and found[:60_000, 0].min() > 0.99 and found[60_000:, 1].min() > 0.99


def prose(seed, kind, count):
    rng = np.random.default_rng(seed)
    parts = {"aa": ["ka", "to", "ri", "nu"], "bb": ["sch", "ein", "und", "ver"], "cc": ["ção", "lhe", "os", "ei"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.integers(1, 4))) for _ in range(count))


def test_code_switching(spark):
    rows = [(k, kind, prose(10 * k + j, kind, 80)) for k in range(20) for j, kind in enumerate(["aa", "bb", "cc"])]
    mixed = " ".join([prose(1001, "aa", 12), prose(1002, "bb", 9), prose(1003, "cc", 15), prose(1004, "aa", 6)])
    wanted = ["aa"] * 12 + ["bb"] * 9 + ["cc"] * 15 + ["aa"] * 6
    docs = spark.createDataFrame([(k, lang, text) for k, (_, lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    model = language_crf.model_of(docs, F.lit(True))
    asked = spark.createDataFrame([(7, "1: " + mixed + " ½ ²!", "zz"), (8, None, "zz"), (9, "42", "zz")], "doc_id long, text string, lang string")
    found = sorted(language_crf.word_languages(asked, model).collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(len(wanted))) and " ".join(r.word for r in found) == mixed
    assert sum(r.lang == w for r, w in zip(found, wanted, strict=True)) >= 0.95 * len(wanted)
    steps = np.exp(model.value[3])
    assert all(steps[k, k] > max(np.delete(steps[k], k)) for k in range(3))  # a language mostly goes on


def test_awkward_rows(spark, documents, awkward, nothing):
    found = {r.doc_id: r for r in language_crf.document_languages(documents).collect()}
    assert set(found) == set(awkward)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found.values())  # no row has a language
    assert {i: r.held_out for i, r in found.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in awkward}
    assert language_crf.document_languages(nothing).count() == 0
    named = documents.withColumn("lang", F.when(F.col("doc_id") == 19, "ja").when(F.col("doc_id") < 18, "xx")).unionByName(documents.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    found = {r.doc_id: r for r in language_crf.document_languages(named.union(named)).dropDuplicates().collect()}
    assert len(found) == len(awkward) + 1 and found[None].held_out is False
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {0, 1, 2} and all(0 <= r.score <= 1 for r in found.values())
    assert found[6].lang_pred == "xx"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    found = QUERIES["op12_random_field"](spark, SF).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
