"""The training-corpus pipeline: quality, near-duplicates, benchmark leaks, mix, shards.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept, which is written as Parquet and read again between stages.

Defined results: a document with a null or empty text has no words, so the quality
rules reject it; a null lang or source is a group of its own; of repeated rows, and of
any near copies, the one with the smallest doc_id stays (one without a doc_id only if
all are); very long texts go through whole; an empty table gives an empty result;
further columns, of whatever names, are carried along, but for `shard` and `slot`, which
the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tephra.llm.common import cut, table
from tephra.llm.decontaminate import decontaminate
from tephra.llm.mixing import mixed_documents
from tephra.llm.quality import keep_good
from tephra.llm.sharding import sharded_documents
from tephra.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays; five words, similarity 0.8."""
    return one_of_each(docs, 5, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test window go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or drawn in part, so that sources reach their target weights."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard, with equal texts together where the quotas allow, and a slot in it."""
    return sharded_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL has no XXH64, no hypergeometric draws and no label propagation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
