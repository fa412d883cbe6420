"""The registered queries of this subpackage: each runs its operator, with production parameters, over its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster
from .chat import format_chats
from .common import table
from .exact_dedup import exact_groups
from .filter_audit import audit_filters
from .language_id import identify, train
from .mixing import mix
from .nearest import nearest
from .ngram_join import near_duplicates
from .packing import pack
from .pieces import round_trip
from .secrets import scan_secrets
from .token_counts import count_tokens
from .oracles import CHAT_FORMAT, EXACT_DEDUP, FILTER_AUDIT, MIXING, NEAREST, NGRAM_JOIN, SECRETS, centroids
from .token_files import token_files_round_trip


#: Tools that conversations may call, by their argument schemas.
CHAT_TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "top": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(spark, table(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"), CHAT_TOOLS)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_mixing, op2_language_id, op3_token_files, op4_nearest, op5_ngram_join, op6_packing, op7_exact_dedup, op8_chat_format, op9_secrets, op10_token_counts, op11_sentencepiece, op12_centroids, op13_filter_audit)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Token files, packing, token counts and SentencePiece need tokenizers, and language ID learns: tests hold these against brute force."""
    return {"op1_mixing": MIXING, "op4_nearest": NEAREST, "op5_ngram_join": NGRAM_JOIN, "op7_exact_dedup": EXACT_DEDUP, "op8_chat_format": CHAT_FORMAT, "op9_secrets": SECRETS, "op12_centroids": centroids(), "op13_filter_audit": FILTER_AUDIT}
