"""A corpus pipeline of five operators of tessella.llm.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last keep the columns of
documents. Every stage works on all rows it gets. Documents with a null or empty text fail the quality rules and go with the first
stage. Rows that repeat are one class of near duplicates, of which one row stays; the mix may then take a document up to
twice, as rows of its own. Ties go as the operators say: the kept one of a class, the documents of one length in the mix
and the order of equal texts in a shard are decided by seeded hashes and ids. Very long texts are worked on whole in every
stage. An empty table gives an empty result with the same columns. Extra columns of ``documents`` are carried by all
stages but the last, whatever their names; the last one carries what its operator and the text have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import op02_cgk, op03_hilbert, op05_budget_fit, op06_host_rules, op07_order_minhash
from tessella.llm._store import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's verdict reject."""
    return op06_host_rules.keep_by_host_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return op07_order_minhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return op02_cgk.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return op05_budget_fit.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; texts are carried along."""
    return op03_hilbert.hilbert_shards(docs, keep=("n_chars", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("sharding", sharding),
]

#: Alignment, LSH and knapsack fitting aren't SQL. tests/llm/test_pipeline.py holds each stage against its operator, and
#: the other tests in that folder hold the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
