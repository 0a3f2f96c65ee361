import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from tidemark.llm import alignment
from tidemark.llm.bpe import byte_letters, merging_engine
from tidemark.llm.queries import QUERIES
from tidemark.llm.tables import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "  two  spaces ", "\nline", "a\n\nb", "a\tb\r\nc d", "x\x1cy z", "▁ lower one", "<s> </s> <unk> <0x0A> <|endoftext|> 's", "a\x00b", "ﬁ ½ Å é 日本語 😀 👩‍👩‍👧", " ", "\n", "   \n ", "tail \n",
    "it's we'll I'VE", "non\xa0breaking　space", "word" * 60, "a b c", "don't  stop\n now\n\tthen",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    with open(A, encoding="utf-8") as file, open(B, "rb") as other:
        return alignment.Aligner(file.read(), other.read())


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, hash) by row, from whole texts and byte ranges."""
    a, b = libraries
    letters, words = byte_letters(), {k: w for w, k in a.get_vocab().items()}

    def ranges(ids, spelt):
        out, at = [], 0
        for k in ids:
            out.append((k, at, at + len(spelt(k))))
            at += len(spelt(k))
        return out, b"".join(map(spelt, ids))

    spell_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    rows, per_pair = [], Counter()
    for text in texts:
        a_ranges, a_data = ranges(a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(letters[c] for c in words[k])) if text else ([], b"")
        b_ranges, b_data = ranges(b.encode(text), spell_b) if text else ([], b"")
        if not text or not a_data == b_data == (" " + text).encode():
            rows.append(([], [], []))
            continue
        links = [(x, y) for x, s, e in a_ranges for y, t, f in b_ranges if s < f and t < e] if len(a_ranges) < 800 else swept(a_ranges, b_ranges)
        ends = sorted({e for *_, e in a_ranges} & {e for *_, e in b_ranges})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(k) for k, s, e in side if start <= s and e <= end) for side in (a_ranges, b_ranges)) if len(a_ranges) < 800 else None)
            start = end
        rows.append((a_ranges, b_ranges, links, groups))
        per_pair.update(set(links))
    best = {}
    for (x, _), n in per_pair.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for a_ranges, b_ranges, links, *groups in rows:
        counts = [(per_pair[pair], best[pair[0]]) for pair in links]
        known = groups and None not in groups[0]
        digest = hashlib.sha256(";".join(groups[0]).encode()).hexdigest() if known else None if groups else ""
        out.append((len(a_ranges), len(b_ranges), len(groups[0]) if groups else 0, len(links), sum(n == m for n, m in counts), sum(n for n, _ in counts), digest))
    return out


def swept(a_ranges, b_ranges):
    out, j = [], 0
    for x, s, e in a_ranges:
        while b_ranges[j][2] <= s:
            j += 1
        k = j
        while k < len(b_ranges) and b_ranges[k][1] < e:
            out.append((x, b_ranges[k][0]))
            k += 1
    return out


def same(found, wanted):
    assert len(found) == len(wanted)
    for got, want in zip(found, wanted, strict=True):
        assert got[:6] == want[:6] and want[6] in (None, got[6])


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("limits", [{}, {"CHUNK_BYTES": 900, "RUN": 50, "TOGETHER": 60, "BETWEEN": 2, "UNITS_BYTES": 3000}])
def test_alignment(spark, documents, awkward, nothing, libraries, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    texts = dict(awkward) | {100 + k: t for k, t in enumerate(ODD)}
    if limits:  # so small runs mean a job for each
        texts = {i: texts[i] for i in (0, 1, 2, 3, 5, 11, 16, 100, 101, 105, 108)}
    extra = [(i, t, None, "s", 1, "c", "d", 0.5, 3) for i, t in texts.items()]
    extra += [extra[4], extra[4], (None, "ids may be null", None, "s", 1, "c", "d", 0.5, 3)]
    frame = spark.createDataFrame(extra, documents.schema).repartition(3)
    found = alignment.align_tokens(frame, A, B)
    assert found.columns == ["doc_id", *FIELDS[:6], "groups_sha256"]
    order = lambda x: (x[0] is not None, x[0] or 0)
    got = sorted(((r.doc_id, tuple(r[f] for f in FIELDS)) for r in found.collect()), key=order)
    extra.sort(key=order)
    same([v for _, v in got], brute([r[1] or "" for r in extra], libraries))
    assert alignment.align_tokens(nothing, A, B).count() == 0


def test_units_are_whole_texts(aligner, libraries):
    a, b = libraries
    rng = random.Random(2)
    parts = ["foo", "bar's", "Ünï", "日本", "12", "!?", "\n", " ", "  ", "\t", "▁", "\x1f", "\xa0", "😀", "a" * 30]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    for text in texts:
        units = aligner.units(text)
        assert "".join(units) == " " + text
        tokens = list(aligner.tokens(units))
        assert [k for x, _ in tokens for k in x] == a.encode(" " + text, add_special_tokens=False).ids, text
        if "▁" in text:  # B takes it for a space, so the bytes differ anyway
            assert None in aligner.align(units).values()
        else:
            assert [k for _, y in tokens for k in y] == b.encode(text), text


def test_labels():
    labels = alignment.label_string(np.array([2, 3, 6]), np.array([1, 3, 6]))
    assert labels == b"bax..x"
    assert [x.tolist() for x in alignment.aligned(labels)] == [[0, 0, 1, 2], [0, 1, 1, 2], [3, 1], [2, 1], [2, 1]]
    assert [x.tolist() for x in alignment.aligned(b"")] == [[], [], [], [], []]


def test_parts_round_trip():
    parts = [np.arange(5), np.zeros(0, np.int64), np.array([-3, 1 << 40])]
    assert [x.tolist() for x in alignment.expanded(alignment.squeezed(*parts))] == [x.tolist() for x in parts]


def test_query(spark, sf_dir, libraries):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    found = {r.doc_id: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_byte_labels"](spark, sf_dir).collect()}
    ids = sorted(texts)
    same([found[i] for i in ids], brute([texts[i] for i in ids], libraries))


def test_plain_units_pass_the_library_together(aligner, libraries, monkeypatch):
    units = [*dict.fromkeys(u for text in [*ODD, "plain wörds and\nlines, 12 of them's ¼ done " + "long" * 200] for u in aligner.units(text))]
    given, library = [], aligner.a

    class Counting:
        def encode_batch_fast(self, some, **options):
            given.extend(some)
            return library.encode_batch_fast(some, **options)

    monkeypatch.setattr(aligner, "a", Counting())
    found = [a for a, _ in aligner.tokens(units)]
    assert " wörds" not in given and "\nlines," not in given and " plain" not in given and " done" not in given
    assert " 日本語" in given and any("\xa0" in u for u in given) and any("long" in u for u in given)
    assert found == [x.ids for x in library.encode_batch_fast(units, add_special_tokens=False)]


def small_vocabulary(entries, merges):
    letters = {b: c for c, b in byte_letters().items()}
    words = [*(letters[b] for b in range(256)), *entries]
    tokenizer = Tokenizer(BPE({w: k for k, w in enumerate(words)}, [tuple(m.split(" ")) for m in merges]))
    tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
    return tokenizer


@pytest.mark.parametrize(
    ("entries", "merges"),
    [
        (["aa", "aaa", "ab", "aab"], ["a a", "aa a", "a b", "aa b"]),
        (["bc", "ab", "abc", "cb", "cbc"], ["b c", "a b", "ab c", "c b", "cb c"]),  # the third is never reached, nor the last
        (["abc", "ab"], ["a b", "ab c"]),  # ids against the order of merges
        (["ab", "bc", "abc"], ["a b", "b c", "ab c", "a bc"]),  # two merges with one result
    ],
)
def test_merging_engine(entries, merges):
    tokenizer = small_vocabulary(entries, merges)
    engine = merging_engine(tokenizer.to_str())
    assert (engine is None) == (entries[0] == "abc" or len(merges) > len(entries))
    rng = random.Random(4)
    for _ in range(3000 if engine else 0):
        text = "".join(rng.choice("aaabbc ") for _ in range(rng.randint(0, 14)))
        assert engine(text) == tokenizer.encode(text).ids, text


def test_merging_engine_of_the_vocabulary(libraries):
    with open(A, encoding="utf-8") as file:
        engine = merging_engine(file.read())
    words = [w for w in libraries[0].get_vocab() if w.isascii() and w.isalpha()]
    rng = random.Random(5)
    texts = [" ".join(rng.choice(words) + rng.choice(words)[: rng.randint(0, 5)] + rng.choice(["", "é", "aaaa", "==", "'s"]) for _ in range(40)) for _ in range(500)]
    assert [engine(t) for t in texts] == [x.ids for x in libraries[0].encode_batch(texts, add_special_tokens=False)]


def test_what_is_known_is_forgotten(aligner):
    rng = random.Random(6)
    chunks = [["".join(rng.choice([" ab", " cd'e", "\nf", " ▁", "  ", "é", "日"]) for _ in range(rng.randint(0, 9))) for _ in range(20)] for _ in range(30)]
    little, much = alignment.Known(aligner, 6000), alignment.Known(aligner, 1 << 30)
    for texts in chunks:
        assert alignment.linked_chunk(little, texts)["groups_sha256"] == alignment.linked_chunk(much, texts)["groups_sha256"]
        assert str(alignment.linked_chunk(little, texts)) == str(alignment.linked_chunk(alignment.Known(aligner, 1 << 30), texts))
        assert len(little) == len(little.groups) == len(little.counts) == len(little.asked) and little.counts[:, 3].sum() == len(little.pairs)
    assert len(little) < len(much)
