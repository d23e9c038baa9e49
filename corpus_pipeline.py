"""A corpus from raw documents: language, near copies, benchmark text, mixture, shards.

Each stage takes (spark, documents, table folder) and works on all rows that the
stage before kept; it returns the columns of its input, the last one also the
shard. ``run`` writes every stage's result as Parquet to the shared folder and goes
on from what it reads back, so a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyscope.llm import decontaminate, jaccard_join, language, mixing, sharding
from tallyscope.llm.common import table
from tallyscope.session import checkpoint_root

SHARDS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a determined language; learnt from the raw documents that are not held out.

    NULL and empty texts and texts without a letter go. Rows that repeat stay or go together.
    """
    return language.keep_known_language(docs, language.learn_from_documents(table(spark, sf_dir, "documents")))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near copies; rows that repeat an id stay together."""
    return jaccard_join.class_heads(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that a source's bytes go with the square root of its size."""
    return mixing.mix_sources(docs, copy="_copy").drop("_copy")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of near equal bytes and the position in it, by ascending id."""
    order = [c for c in ("doc_id", "source", "lang") if c in docs.columns]
    return sharding.shard_by_bytes(docs, SHARDS, order, sharding.text_size())


STAGES = [
    ("language", known_language),
    ("near copies", one_of_each_class),
    ("benchmark", without_benchmark),
    ("mixture", mixed),
    ("shards", sharded),
]

#: Naive Bayes and equal results of its arithmetic can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{checkpoint_root(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
