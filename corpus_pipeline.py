"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before has written.  Toxic documents go, one document
of each group of near copies stays, strings that repeat across documents are cut
out, documents that hold benchmark passages go, and the rest is packed.

Defined cases: a null or empty text is not toxic, near nothing and not contaminated;
it stays as it is and packs as its closing id alone.  Rows of one id are one document:
they stay or go together; rows without an id stay.  Of documents of equal texts the
one of the smallest id stays.  Columns beside those of documents are carried along,
whatever their names, up to packing, which returns its own.  No rows give none.
Stages are written below the shared folder and stay there, since the result reads
the last of them when it is asked for.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import clean_documents
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.suffix_dedup import shortened_documents
from tidemark.llm.tables import shared_folder, table
from tidemark.llm.toxicity import clean_texts


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_texts(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, part=80, whole=100)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shortened_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), longest=1024, closing_id=0)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: SQL can express neither learning nor encoding; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of `sf_dir`; what lies between them is written to the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
