"""Corpus pipeline: documents in, clean and encoded documents out.

Stages, in order: quality rules, line dedup, n-gram Jaccard join, benchmark
decontamination, SentencePiece encoding. Every stage is written as Parquet
under the shared checkpoint folder and read again by the next. All but the last
return the columns of documents; ``n_chars`` follows the text.

Defined cases: rows with null text are empty documents and fail the quality
rules; an empty table gives an empty result; repeated rows are equal copies, of
which the third stage keeps one; further columns of the documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import decontaminate, line_dedup, ngram_join, quality_rules, sentencepiece_dropout
from loglake.llm.common import save, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps, unchanged."""
    return quality_rules.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines of templates that recur across documents."""
    return line_dedup.clean_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies: the smallest doc_id."""
    return ngram_join.keep_representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without benchmark spans."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, variant, lossless of every document left."""
    import public_tokenizers

    return sentencepiece_dropout.encode(docs, public_tokenizers.path(sentencepiece_dropout.MODEL))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece_encoding", encode),
]

#: SentencePiece merges cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
