"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pyrewatch.llm import sql
from pyrewatch.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if text:
            SQL[name] = text
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.simhash import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", sql.REPEATED_WORDS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_sharding", sql.sharding())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.packing import pack
    from pyrewatch.llm.stages import Stages

    return pack(table(spark, sf_dir, "documents"), Stages(spark))


@query("op7_exact_top_k", sql.TOP_PRODUCTS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from pyrewatch.llm.ball_tree import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_benchmark_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_centroid_clustering", sql.lloyd())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.lloyd import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


@query("op12_conversation_repair", sql.conversation_repair())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.conversations import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))


@query("op13_quality_rules", sql.quality_rules())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyrewatch.llm.rules import judge

    return judge(table(spark, sf_dir, "documents"))
