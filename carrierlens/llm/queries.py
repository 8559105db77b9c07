"""The queries of this subpackage and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carrierlens.llm import ann, bitsliced, packing, pieces, sharding, simhash, substring, surrogates, toxicity, warc
from carrierlens.llm.common import read


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_replaced")


def op2_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op3_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_inner_products(read(spark, sf_dir, "embeddings"))


def op4_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op10_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_sentencepiece_dropout": op2_sentencepiece_dropout,
    "op3_bit_sliced_topk": op3_bit_sliced_topk,
    "op4_warc_normaliser": op4_warc_normaliser,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_histogram_sharding": op9_histogram_sharding,
    "op10_stable_projection_ann": op10_stable_projection_ann,
}

#: 13-word windows as joined strings; a window's first owner by min(doc_id).
OP5_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
least_id AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, p + k AS i FROM win JOIN least_id USING (s), range(0, 13) AS r(k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Base32 of the SHA-1, five bits a letter.
OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, min(page_id) AS least,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8)) & 31)::BIGINT + 1, 1) FOR i IN range(0, 32)], 'string_agg', '') AS b32
  FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM p JOIN d USING (h)
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5
"""

ORACLE: dict[str, str] = {"op3_bit_sliced_topk": OP3_SQL, "op4_warc_normaliser": OP4_SQL, "op5_substring_dedup": OP5_SQL}
