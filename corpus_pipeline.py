"""From raw documents to token ids: the stages of the corpus pipeline, in their order.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor
kept, and all but the last return the columns of ``documents``. A stage's result is
written and read again before the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vidmatch.llm import bpe, decontaminate, exact, language, simhash
from vidmatch.session import cut_lineage, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, hence of no language, go."""
    ship_package(spark)
    return language.recognised(docs, language.fit(docs.where(language.remainder("doc_id", 5) != 0)))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays."""
    ship_package(spark)
    return exact.keep_first(docs)


def first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the one with the smallest doc_id stays."""
    ship_package(spark)
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to one edit in ten words, go."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` with ``ids`` and ``token_bytes``, how many bytes each id stands for."""
    ship_package(spark)
    return bpe.encode(docs, bpe.default_ranks(spark))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact_dedup", first_copies),
    ("simhash", first_near_copies),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
