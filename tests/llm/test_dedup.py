import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import components as cc
from tidemark.llm import jaccard_join, suffix_dedup
from tidemark.llm.queries import QUERIES
from tidemark.llm.signature_tree import Members, Node
from tidemark.llm.tables import table


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeats_match_brute_force(documents, awkward, hot):
    expected = brute.without_repeats(awkward)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(documents, hot).collect()}
    assert found == expected


def test_repeats_on_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op1_bucket_pointer"](spark, sf_dir).collect()}
    assert found == brute.without_repeats(docs)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_string_in_every_chunk(spark, awkward, parts):
    """A notice that every document has, each in a chunk of its own: equal strings are made one in parts of the chunks."""
    from tests.llm.conftest import prose

    notice = prose(11, 60)
    texts = {k: f"{prose(100 + k, 15)} {notice} {prose(200 + k, 15)}" for k in range(24)} | {100 + k: t for k, t in awkward.items()}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(len(texts), "doc_id")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(rows, 2, parts).collect()}
    assert found == brute.without_repeats(texts) and sum(n > 0 for _, n, *_ in found.values()) >= 23


def test_hot_strings_are_combined():
    def payload(*rows):
        table = np.zeros(len(rows), suffix_dedup.STRING)
        for k, (doc, place, letter) in enumerate(rows):
            table[k] = (doc, place, np.full(suffix_dedup.LENGTH, ord(letter)))
        return table.tobytes()

    def read(raw):
        return [(int(i), int(p), chr(b[0])) for i, p, b in np.frombuffer(raw, suffix_dedup.STRING)]

    one, two = payload((5, 1, "a"), (3, 9, "b")), payload((4, 7, "a"), (3, 2, "b"), (8, 0, "c"))
    assert sorted(read(suffix_dedup.combined_hot([one, two]))) == [(3, 2, "b"), (4, 7, "a"), (8, 0, "c")]
    assert [read(x) for x in suffix_dedup.earliest_hot([one, two])] == [[(4, 7, "a"), (3, 2, "b")], [(4, 7, "a"), (3, 2, "b"), (8, 0, "c")]]


def test_repeated_rows_and_null_ids(spark, awkward):
    text = awkward[6]
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    removed = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect()), key=repr)
    n = len(text.encode())
    assert removed == sorted([(None, 0), (1, n), (1, n), (2, n)], key=repr)
    same = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(same).collect()] == [0, 0]


def test_shortened_documents_keep_their_columns(documents, awkward, nothing):
    out = suffix_dedup.shortened_documents(documents)
    assert out.columns == documents.columns and out.schema == documents.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[7].text == "" and rows[7].n_chars == 0 and rows[6].text == awkward[6] and rows[6].chunk == "c"
    assert suffix_dedup.shortened_documents(nothing).count() == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_refinement_sorts_suffixes():
    rng = random.Random(0)
    text = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)) * 2, np.uint8)
    bucket = suffix_dedup.refined(text)
    raw = text.tobytes()
    n = len(raw)
    pieces = [raw[i : i + suffix_dedup.LENGTH] for i in range(n - suffix_dedup.LENGTH + 1)]
    order = sorted(range(len(pieces)), key=lambda i: pieces[i])
    for a, b in zip(order, order[1:], strict=False):
        assert (bucket[a] == bucket[b]) == (pieces[a] == pieces[b]) and bucket[a] <= bucket[b]


@pytest.mark.parametrize("tile", [jaccard_join.TILE, 1])
def test_components_match_brute_force(documents, awkward, tile):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(documents, tile=tile).collect()}
    assert found == brute.components(awkward)


def test_components_on_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_signature_trees"](spark, sf_dir).collect()}
    assert found == brute.components(docs)


def test_tree_of_mixed_sizes():
    rng = np.random.default_rng(6)
    passages = [rng.choice(1 << 62, 50, replace=False).astype(np.uint64) for _ in range(24)]
    sets = []
    for _ in range(150):
        own = np.unique(np.concatenate([passages[k] for k in rng.choice(24, rng.integers(1, 21), replace=False)]))
        sets += [own, np.unique(np.concatenate((own[3:], rng.choice(1 << 62, 3).astype(np.uint64))))]
    sizes = [len(x) for x in sets]
    members, plain = Members(sets, sizes, 80, 100), Members(sets, sizes, 80, 100)
    tree = members.tree(list(range(len(sets))))
    members.walk(tree, tree)
    for a in range(len(sets)):
        for b in range(a):
            plain.compare(a, b)
    roots = {(members.root(k), plain.root(k)) for k in range(len(sets))}
    assert len(roots) == len({a for a, _ in roots}) == len({b for _, b in roots})
    low, high = Node([]), Node([])
    for node in (low, high):
        node.bitmap, node.excess, node.least, node.most = np.packbits(np.arange(4096) < 360).view(np.uint64), 0, 50, 1000
    assert members.possible(low, high)


def test_chains_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    docs = {}
    for k in range(40):
        words[rng.randrange(len(words))] = f"n{k}"
        docs[100 + k] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(frame).collect()} == brute.components(docs)


def test_one_of_each(documents, awkward, nothing):
    stay = {i for i, (_, c) in brute.components(awkward).items() if i == c}
    out = jaccard_join.one_of_each(documents)
    assert out.columns == documents.columns and {r.doc_id for r in out.collect()} == stay
    assert jaccard_join.one_of_each(nothing).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in cc.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert found == {x: find(x) for x in list(root)}
    assert cc.components(spark.createDataFrame([], "a int, b int")).agg(F.count("*")).first()[0] == 0


def test_long_words_of_one_polynomial(spark):
    """Two words of 1,024 letters that a polynomial modulo 2 ** 64 can't tell apart."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    docs = {1: one, 2: one.translate({97: "b", 98: "a"}), 3: one + "é" * 4000, 4: "a" * 4096, 5: "a" * 4096, 6: None}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(frame).collect()} == brute.components(docs)


def test_texts_decide_where_hashes_lie(spark, monkeypatch):
    """A tree that takes every pair for similar: only the texts can tell."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    docs = {}
    for k in range(12):
        own = words[:30] + [f"x{k // 3}{j}" for j in range(8)]
        own[rng.randrange(30)] = f"n{k}"
        docs[k] = " ".join(own)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(Members, "enough", lambda self, overlap, a, b: True)
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_components(frame).collect()} == {i: c for i, (_, c) in brute.components(docs).items()}


def test_carried_bytes():
    assert jaccard_join.carried_bytes(1 << 30, 144) == 4 and jaccard_join.carried_bytes(64 << 20, 1) == 4


def test_buckets_grow_with_the_text(spark, monkeypatch, documents, awkward):
    from tidemark.llm import exchange

    monkeypatch.setattr(exchange, "BUCKET_BYTES", 500)
    monkeypatch.setattr(jaccard_join, "carried_bytes", lambda size, buckets: 5)
    assert exchange.buckets_of(documents, 10**6) == 2000
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(documents).collect()} == brute.components(awkward)


def test_hot_strings_are_refined():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (400, suffix_dedup.LENGTH)).astype(np.uint8)
    rows[100:300] = rows[rng.integers(0, 40, 200)]
    rows[300:, :96] = rows[0, :96]
    bucket = suffix_dedup.refined_strings(rows)
    texts = [r.tobytes() for r in rows]
    order = sorted(range(400), key=lambda k: texts[k])
    for a, b in zip(order, order[1:], strict=False):
        assert (bucket[a] == bucket[b]) == (texts[a] == texts[b]) and bucket[a] <= bucket[b]


@pytest.mark.parametrize("most", [2, 4096])
def test_join_on_hot_keys(spark, most):
    from tidemark.llm.tables import joined_on_hot

    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(400)] + [(None, 1)], "key int, n int")
    values = spark.createDataFrame([(k, f"v{k}") for k in range(1, 9)], "key int, v string")
    weighed = values.join(rows.groupBy("key").agg(F.count("*").alias("w")), "key", "left").fillna(0, ["w"])
    found = sorted(tuple(r) for r in joined_on_hot(rows, weighed, "key", "w", 401, most).collect())
    assert found == sorted(tuple(r) for r in rows.join(values, "key").collect())


@pytest.mark.parametrize(("parts", "task_edges"), [(1, 1 << 18), (7, 100)])
def test_components_of_chains_and_stars(spark, monkeypatch, parts, task_edges):
    from tidemark.llm.components import components

    monkeypatch.setattr(cc, "TASK_EDGES", task_edges)
    rng = random.Random(5)
    chain, star = [(k, k + 1) for k in range(1000, 1200)], [(5, k) for k in range(2000, 2400)]
    some = [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    edges = [*chain, *star, *some, (7, 7), (None, 3), (1200, 2001)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    found = [(r.node, r.root) for r in components(frame).collect()]
    assert len(found) == len(set(found)) and dict(found) == {x: find(x) for x in list(root)}
    assert components(frame.filter("a = b")).count() == 0
