"""The corpus pipeline: five stages, each over all documents that the one before kept.

A document leaves at the first stage that turns it down; the last stage returns the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, exact_dedup, language, pieces, simhash
from lodestone.llm.common import alone, release

STAGES = [
    ("language", language.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", simhash.stage),
    ("decontaminate", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: Fitted models, link components and piece encodings are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written as Parquet and read again by the next.

    What a stage wrote besides its rows is deleted once these are written, and its rows after the next stage's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = alone(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        release(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
