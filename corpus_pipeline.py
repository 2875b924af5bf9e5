"""The corpus pipeline: stages that take the documents table to what a model is trained on.

Every stage takes tables with further columns of any names and keeps them (but the last, which returns ids, counts and digests), null in
any column, empty and very long texts, repeated rows and empty tables; what becomes of each is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseledger.llm import queries
from proseledger.llm.shared import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts score the share of good labels, so they stay where that is at the cut or above; repeated rows stay or go together.
    """
    return queries.keep_good(spark, docs, sf_dir)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; n_chars follows the text.

    No row goes. Null texts become empty ones, blank lines stay, null sources aren't sources; repeated rows are one document.
    """
    return queries.without_spread_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id (a null id is the largest).

    Empty and null texts are one class, so one of them stays; of repeated rows one stays.
    """
    from proseledger.llm.near_dup import keep_one

    return keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none; repeated rows stay or go together; items with a null text are searched for in none, those with a null id like all others.
    """
    from proseledger.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; a null or empty text has no tokens. Repeated rows have a row each."""
    from proseledger.llm.bpe import digest_texts

    return digest_texts(docs, queries.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_low_quality),
    ("lines", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: SQL can't express the classifier, the samples of the near-duplicate stage or byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
