"""The dealt queries, one per operator, over their whole tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberlog.llm.common import table
from emberlog.llm.contexttree import score_documents
from emberlog.llm.forest import forest_neighbours
from emberlog.llm.jaccard import jaccard_components
from emberlog.llm.langid import identify_language
from emberlog.llm.maxscore import maxscore_top_k
from emberlog.llm.merkle import manifest_report
from emberlog.llm.merkle_sql import manifest_sql
from emberlog.llm.packing import pack_documents
from emberlog.llm.sharding import shard_documents
from emberlog.llm.pieces import sample_segmentations
from emberlog.llm.quality import quality_scores
from emberlog.llm.rtree import HARD_NEGATIVES_SQL, hard_negatives, rotated_label
from emberlog.llm.substring import repeat_report
from emberlog.llm.warc import archive_pages


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op3_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore_top_k(table(spark, sf_dir, "embeddings"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op10_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_report(table(spark, sf_dir, "documents"))


def op12_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hard_negatives(table(spark, sf_dir, "embeddings"), rotated_label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gumbel_segmentations": op1_gumbel_segmentations,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_certified_packing": op3_certified_packing,
    "op4_context_tree": op4_context_tree,
    "op5_maxscore": op5_maxscore,
    "op6_minimax_shards": op6_minimax_shards,
    "op7_string_kernel_language": op7_string_kernel_language,
    "op8_projection_forest": op8_projection_forest,
    "op9_content_addressed_warc": op9_content_addressed_warc,
    "op10_vertical_jaccard": op10_vertical_jaccard,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_factorisation_machine": op12_factorisation_machine,
    "op13_rtree_negatives": op13_rtree_negatives,
}

_VECTORS = """
usable AS (
    SELECT vec_id, embedding AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""

ORACLE_SQL: dict[str, str] = {
    "op5_maxscore": f"""
WITH {_VECTORS},
whole AS (SELECT vec_id, list_transform(v, lambda x: floor(256 * x::DOUBLE)) AS w FROM usable),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5""",
    "op9_content_addressed_warc": """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexed,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
    FROM pages
)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((('0x' || substr(hexed, 1 + 10 * (i // 8)::INTEGER, 10))::BIGINT) >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER, 1)), '')
        AS payload_digest,
    CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to
FROM payloads""",
    "op11_merkle_manifest": manifest_sql(),
    "op13_rtree_negatives": HARD_NEGATIVES_SQL,
}
