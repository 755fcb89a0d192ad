"""A training corpus from ``documents``: toxic texts out, exact and near copies out, benchmark passages out, sources mixed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows to the shared scratch folder and reads them back; what a
stage wrote on its way, and the rows of the stage before, are deleted as soon as its own rows are written.

Defined results: a null or empty text is not toxic, is one exact copy of every other such text (the row of the
largest doc_id stays), is nobody's near copy, is never contaminated, and takes its source's place in the
mixture without tokens. Rows that repeat doc_id and text are exact copies; rows that repeat only the doc_id are judged by their own
texts, but stay or go together as near copies. Very long texts are read whole. Empty tables give empty results. Further columns, whatever
their names, are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from melodyspark.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from melodyspark.llm.scratch import release, settled, small_batches, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: the scores of the first stage are a trained model's, which SQL cannot express; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs, last = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            release(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
