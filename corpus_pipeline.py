"""A corpus pipeline of five stages: language ID, exact dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and read
again. All but the last return the columns of documents.

Null and repeated doc_ids are rows of their own throughout; null texts count as empty; tables without rows give none; other
columns are carried along and not read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import new_path, table
from tidemill.llm.exact_dedup import drop_exact_copies
from tidemill.llm.language_id import keep_known_languages
from tidemill.llm.mixing import mix_documents
from tidemill.llm.ngram_join import drop_near_copies
from tidemill.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones among them), or of no language with a posterior of a half, go; copies share a fate. Without labels to learn from all stay."""
    return keep_known_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the row with the smallest doc_id stays, null ids last; of rows that repeat id and text one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five-word shingles connect, the one with the smallest doc_id stays. Texts without words link with nothing; another text under the same id stays or goes by itself."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are read up to 1.5 times as often as the largest; every document is read at least once. Null is a source; rows of one id are read equally often."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix at their places in sequences of at most 2048 tokens."""
    return pack(docs, cache_entries=75_000)  # a worker that other stages have used already has less to spare


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learning, tokenizers and similarity joins are beyond SQL; tests hold the operator of each stage against a brute-force version, and the stages together against the rows that should stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
