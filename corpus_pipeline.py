"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Defined cases, each as the stage's operator states them: null and empty texts are scored like others and, if kept, have no
line, no benchmark item and size 0, and are one group of near copies, of which the least doc_id stays; rows without a doc_id
stay only if no row of their group has one; of repeated rows and exact copies one stays; very long texts go through whole; ties go
to the smaller doc_id; an empty table gives an empty result with the columns of the last stage, tables without labels keep every
document (the score is 0.5), an empty benchmark drops none; further columns, of any name, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, line_dedup, mixing, quality_fm, simhash
from panelforge.llm.common import scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality_fm.stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, but for each line's first place."""
    return line_dedup.stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.stage(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document that came so far."""
    return mixing.copies(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("source mixing", mix)]
#: The classifier's scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark, keep_last=True):  # what a stage wrote on its way goes as soon as its result is written
            docs = written(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
