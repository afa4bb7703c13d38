"""Corpus pipeline over ``documents``: five filtering and mixing stages.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept;
between stages the rows are written as Parquet and read again.  All stages but
the last return the columns of ``documents``; the last returns one row per
remaining document with the words that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zymolith.llm.decontamination import drop_contaminated
from zymolith.llm.exact_dedup import drop_exact_copies
from zymolith.llm.minhash import drop_near_copies
from zymolith.llm.mixing import mix_sources
from zymolith.llm.shared import written
from zymolith.llm.toxicity import drop_toxic, fit_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold; each row is judged by its text, null and empty texts alike."""
    return drop_toxic(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id; null and empty texts are one text, a null id is below all others."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the least id; a null id is above all others."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row; null and empty texts have none, a null source is one of its own."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL expresses neither the classifier nor the sampling keys.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that all stages keep.

    An empty table gives an empty result; columns of any other name are carried up
    to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
