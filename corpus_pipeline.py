"""A corpus pipeline of five stages: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes every stage as Parquet to the shared folder and reads it back as the next one's input, so a lost executor
repeats nothing before the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyrewatch.llm.decontamination import drop_contaminated
from pyrewatch.llm.packing import pack
from pyrewatch.llm.quality import drop_rejected
from pyrewatch.llm.queries import table
from pyrewatch.llm.simhash import one_of_each
from pyrewatch.llm.stages import Stages
from pyrewatch.llm.substring_dedup import drop_repeats
from pyrewatch.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship_package(spark)
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    ship_package(spark)
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id holds; a text that is all repeats becomes empty."""
    ship_package(spark)
    return drop_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    ship_package(spark)
    return pack(docs, Stages(spark))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_leaks", benchmark_leaks), ("packing", packing)]

#: A trained model, exact hashes and tokenizers are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; a stage's table is removed once the next one is written."""
    ship_package(spark)
    stages = Stages(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stages.keep(stage(spark, docs, sf_dir))
        if before is not None:
            stages.drop(before)
        before = docs
    return docs
