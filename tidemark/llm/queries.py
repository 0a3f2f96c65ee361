"""The operators applied to the driver's tables: one query for each, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .decontamination import contamination
from .hard_negatives import hard_negatives
from .jaccard_join import similar_components
from .language_crf import document_languages
from .packing import pack
from .page_differencing import main_texts
from .quality import quality_verdicts
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .tables import table
from .token_counts import count_tokens
from .toxicity import toxicity
from .warc import page_records, resolve_revisits


def op1_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_records(table(spark, sf_dir, "pages"), delay=40_001)
    resolved = resolve_revisits(records, bucket_width=1 << 16)
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.select("record_id", "ts", "kind", "canonical_url", "status", "origin_id", F.array_join(pairs, ";").alias("headers"))


OP2_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS VARCHAR) AS chars,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages),
parts AS (
  SELECT *, lower(regexp_replace(regexp_extract(bare, '^[^/?]*'), ':(80|443)$', '')) AS host,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           regexp_replace(bare, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', '') AS rest
  FROM base),
named AS (
  SELECT page_id, digest, chars, page_id // 100 AS day, host || regexp_replace(rest, '/+$', '') AS canonical_url,
         CASE WHEN digest[1] <> '0' THEN digest END AS etag, CASE WHEN digest[1] = '0' THEN substr(digest, 2, 8) END AS lm
  FROM parts),
origins AS (SELECT canonical_url, 2 * page_id AS ts, etag, lm, chars, 2 * page_id AS id FROM named),
visits AS (SELECT canonical_url, 2 * page_id + 40001 AS ts, etag, lm, 2 * page_id + 1 AS id, day + 1 AS day FROM named),
matched AS (
  SELECT v.*, o.id AS oid, o.etag AS oetag, o.lm AS olm, o.chars AS ochars
  FROM visits v ASOF LEFT JOIN origins o ON v.canonical_url = o.canonical_url AND v.ts >= o.ts),
judged AS (
  SELECT *, CASE WHEN oid IS NULL THEN 'no_origin'
                 WHEN etag IS NOT NULL AND oetag IS NOT NULL THEN CASE WHEN etag = oetag THEN 'resolved' ELSE 'etag_mismatch' END
                 WHEN lm IS NOT NULL AND olm IS NOT NULL THEN CASE WHEN lm = olm THEN 'resolved' ELSE 'date_mismatch' END
                 ELSE 'unvalidated' END AS status
  FROM matched)
SELECT CAST(2 * page_id AS BIGINT) AS record_id, CAST(2 * page_id AS BIGINT) AS ts, 'response' AS kind, canonical_url, 'response' AS status,
       CAST(NULL AS BIGINT) AS origin_id, 'content-length=' || chars || ';content-type=text/html;date=' || day || ';server=origin' AS headers
FROM named
UNION ALL
SELECT CAST(id AS BIGINT), CAST(ts AS BIGINT), 'revisit', canonical_url, status,
       CAST(CASE WHEN status IN ('resolved', 'unvalidated') THEN oid END AS BIGINT),
       CASE WHEN status IN ('resolved', 'unvalidated')
            THEN 'content-length=' || ochars || ';content-type=text/html;date=' || day || ';expires=never;server=origin'
            ELSE 'content-length=0;date=' || day || ';expires=never' END
FROM judged
"""


def op3_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op4_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), part=80, whole=100)


def op5_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), longest=1024, closing_id=0)


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=5, low=80, high=100)


OP11_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
         s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 5
"""


def op12_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(table(spark, sf_dir, "documents"))


def op13_byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_bucket_pointer": op1_bucket_pointer,
    "op2_revisits": op2_revisits,
    "op3_ring": op3_ring,
    "op4_signature_trees": op4_signature_trees,
    "op5_noisy_channel": op5_noisy_channel,
    "op6_page_differencing": op6_page_differencing,
    "op7_prefix_counts": op7_prefix_counts,
    "op8_decision_list": op8_decision_list,
    "op9_power_of_two": op9_power_of_two,
    "op10_fm_index": op10_fm_index,
    "op11_norm_buckets": op11_norm_buckets,
    "op12_random_field": op12_random_field,
    "op13_byte_labels": op13_byte_labels,
}

ORACLES = {
    "op2_revisits": OP2_SQL,
    "op11_norm_buckets": OP11_SQL,
}
