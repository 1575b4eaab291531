"""The corpus pipeline: drop what the quality classifier rejects, keep one of each group of near copies, drop documents with
benchmark items, mix sources to their target weights, deal out shards.

Each stage works on all rows its predecessor kept and returns the columns of documents; the last adds shard and slot.

Defined results: null and empty texts are scored like any other, are no copies of anything, hold no benchmark item, and have no words,
so the mix takes them by their source's rate; very long texts are read whole; equal rows are near copies of one doc_id and go through
together, and rows that share a doc_id draw alike in the mix; null doc_ids stay rows of their own until the near copies, where they go
if a row with a doc_id is like them; an empty table gives an empty result; other columns are kept whatever their names, but for
``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontamination, mixing, ngram_join, quality, sharding
from driftline.llm.runtime import materialise
from driftline.plans.shipping import ship


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.without_near_copies(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, names=("shard", "slot"))


STAGES = [
    ("quality classifier", good_only), ("n-gram Jaccard join", one_of_near_copies), ("benchmark decontamination", no_benchmark),
    ("mixing", mixed), ("sharding", sharded),
]
#: The classifier and the join have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
    return docs.select(*[F.col(c) for c in docs.columns])
