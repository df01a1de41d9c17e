"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; run() writes it as Parquet in the shared folder and reads it again for the next one.
ORACLE_SQL is None: SQL can't express SuperMinHash components or the Newton steps of the mix, so the
tests hold the stages against brute force.

Defined cases: a null or empty text fails the base rules and goes; a null id stays through near-dedup
and goes through all others as any row; rows of one id are one document for near-dedup; a null source
is a source of its own; empty tables give no rows; columns of documents go on whatever their names
are, but that the last stage replaces size, shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosy.llm import decontaminate, mix, neardup, quality, shard
from argosy.session import remove_folder, table, with_checkpoint_dir

ORACLE_SQL = None


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage reads beside the whole row, so that no column of a document clashes with one that a stage makes."""
    return docs.select(F.struct("*").alias("_doc"), *(F.col(f"`{c}`") for c in used))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return quality.judge(packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), keep=["_doc"]).filter("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    found = decontaminate.decontaminate(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["_doc"])
    return found.filter(~F.col("contaminated")).select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them."""
    mixed = mix.mix(packed(docs, "doc_id", "text", "source"), keep=["_doc"]).filter("copies > 0")
    return mixed.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, slot and size; columns of these names are replaced."""
    return shard.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the mixed, clean corpus. Stages are written below the checkpoint folder, each run in its own folder; a
    stage's folder goes once the next one is written."""
    with_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
