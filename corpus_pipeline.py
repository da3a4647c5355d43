"""A training corpus from raw documents: toxic texts go, one of each group of near copies stays, benchmark leaks go, sources are mixed to weight, and the rest is written as token shards in training order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pageloom.functions.tables import gone_at_exit, shared_dir
from pageloom.llm import decontaminate, mixing, simhash, token_store, toxicity
from pageloom.llm.common import small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score below 0.7; the classifier is fitted on the labelled rows of the raw table."""
    small_batches(spark)
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(machine) < 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_store.shards_of(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark leaks", drop_leaks),
    ("mixing", mix_sources),
    ("token shards", write_tokens),
]

#: Classifier, fingerprints, spaced seeds and token ids have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written to the shared folder and read again. Results between stages go when the driver ends; the shards and their index stay.

    Rows with null or repeated ids, null and empty texts, null sources and further columns are documents like any other, but of rows that repeat an id the second stage keeps one; ids are numbers. An empty table gives an empty index.
    """
    out = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
        stage(spark, out, sf_dir).write.parquet(path)
        if i < len(STAGES) - 1:
            gone_at_exit(spark, path)
        out = spark.read.parquet(path)
    return out
