"""A corpus pipeline over documents: quality, repeated lines, near-duplicates, benchmark passages, and encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before it kept, read back from Parquet. All but
the last return the columns of documents. A stage works on every row it gets: null texts count as empty, and are
kept by the stages that find nothing wrong with them. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrank.llm import bpe_tree, common, decontaminate, line_dedup, minhash, quality
from quillrank.llm.queries import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated runs of lines."""
    return line_dedup.dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id."""
    return minhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe_tree.encode_decode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", no_repeated_lines),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", no_benchmark),
    ("bpe_encoding", encoded),
]

#: The fitted classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py has a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
