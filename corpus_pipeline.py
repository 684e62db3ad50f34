"""A training corpus in five stages, each one of the operators of tallyvine.llm over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's docs. Tables besides the documents (labels, benchmark) come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyvine.llm.common import read_table, written
from tallyvine.llm.decontaminate import keep_uncontaminated
from tallyvine.llm.mixing import mix
from tallyvine.llm.near_dedup import keep_firsts
from tallyvine.llm.sharding import shard_documents
from tallyvine.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go."""
    return keep_clean(docs, train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return keep_firsts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark occurs go."""
    return keep_uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target: its documents repeat, or some are left out."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row gets a shard and a slot in it."""
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: No stage can be stated in SQL as a whole: the tests hold the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
