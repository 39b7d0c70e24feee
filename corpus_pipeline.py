"""Corpus pipeline: the training-data operators chained over ``documents``, each stage written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topoframe.llm import stages
from topoframe.llm.common import written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.drop_near_copies),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: No stage but the third has a SQL form; tests/llm/test_pipeline.py holds the second to the fourth against brute force, and the first against labels.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
