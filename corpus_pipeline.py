"""The corpus pipeline: STAGES from documents to shards, each written as Parquet and read again as the next one's docs.

Null and empty texts are clean, no copies of anything and of size 0 for the mix, which takes whole documents only, so
that they may be taken or left; rows with null ids or sources are rows like others. Of repeated rows one is left by the
second stage (null texts all stay). An empty table gives no rows in any stage. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common, decontaminate, mixing, near_dup, sharding, toxicity

N_SHARDS = 40
#: SQL can't express trained models, Order MinHash or the schedule; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. The chain is fitted on labelled rows of docs."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays."""
    return near_dup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix has copies of them."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with all its columns and its shard; copies that the mix made are together, as are equal texts."""
    return sharding.sharded(docs, N_SHARDS)


def _stage(f):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, "pipeline")  # of the stage before, which has been written
        with common.owner("pipeline"):
            return f(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (drop_toxic, drop_near_duplicates, drop_contaminated, mix_sources, assign_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
