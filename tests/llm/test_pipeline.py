import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidemark.llm.tables import table


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]

    def written(name, docs):
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = written("toxicity", docs)
    assert docs.columns == columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(kept) <= len(texts) and all(texts[i] == t for i, t in kept.items())

    docs = written("ngram_jaccard_join", docs)
    classes = brute.components(kept)
    stay = {i: t for i, t in kept.items() if classes[i][1] == i}
    assert {r.doc_id: r.text for r in docs.collect()} == stay

    docs = written("suffix_array_dedup", docs)
    shorter = {r.doc_id: r.text for r in docs.collect()}
    expected = brute.without_repeats(stay)
    assert docs.columns == columns and set(shorter) == set(stay)
    for i, t in shorter.items():
        assert abs(len(t.encode()) - (expected[i][0] - expected[i][1])) <= 6 * expected[i][2]

    docs = written("benchmark_decontamination", docs)
    items = {str(r.item_id): r.text for r in table(spark, sf_dir, "benchmark").collect()}
    verdicts = brute.contamination(shorter, items)
    clean = {i: t for i, t in shorter.items() if not verdicts[i][-1]}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == clean

    rows = written("packing", docs).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in clean.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for r in own)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_run_on_awkward_documents(spark, sf_dir, documents, nothing, awkward, tmp_path):
    """Nulls, empty and very long texts, copies and clashing columns; and no documents at all."""
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert {0, 1, 2, 3, 13} <= kept <= set(awkward) and 7 not in kept and 4 not in kept  # copies of 6 and 3
    assert {(r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == 0} == {(0, 1, 1)}
    nothing.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
