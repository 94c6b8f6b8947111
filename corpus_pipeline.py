"""Corpus preparation: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, language_id, line_dedup, mixing, segmentation, shingle_join

#: (name, function of (spark, docs, sf_dir)); every stage but the last returns the columns of documents.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("shingle_join", shingle_join.stage),
    ("mixing", mixing.stage),
    ("segmentation", segmentation.stage),
]

#: Model training, flow routing and sampling cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
