"""The queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .conversation_trie import conversation_trie
from .embedding_dedup import embedding_groups
from .improbable_digest import digest_documents
from .language_id import identify_languages
from .minhash import minhash_groups
from .mixing import mix_sources, mix_sql
from .packing import pack_documents
from .spelling_variants import spelling_variants
from .suffix_dedup import suffix_dedup
from .suffix_tree_lm import score_texts
from .toxicity import score_toxicity
from .transport_stream import store_transport_streams
from .url_filter import filter_sql, filter_urls


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400, passage=240, passage_words=51)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"), shingle_words=5, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_transport_streams(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_packing": op4_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_url_filters": op6_url_filters,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_media_columns": op8_media_columns,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_filters": filter_sql(),
    "op9_mixing": mix_sql(),
}
