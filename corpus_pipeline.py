"""The corpus pipeline: five training-data operators, one after the other, over the documents.

Every stage but the last takes and returns rows with the columns of `documents`, whatever their names; an empty table
gives an empty result in every stage, and each stage states below what it does with nulls, repeats and ties. Texts of
any length are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adslots.llm import decontaminate, mixing, near, quality, sharding
from adslots.llm.common import cut, drop_cut, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has no words and goes; repeated rows are judged alike; a
    null language is a stratum of its own; labels of unknown documents and null labels count for nothing."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id (of those the least text key; of
    rows of one id and text the one with the least fingerprint). A null doc_id comes last; rows with a null text all
    stay; empty texts are copies of each other."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. A null text holds none and stays; repeated rows go or stay alike; items
    without id or text are no passages."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands in the result as often as the mix takes it, or not at all. A document without words is taken no
    times; a null source is a source of its own, last; equal rows share the copies of all."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard, and the place in it, of every document. A null doc_id is a key like any; repeats share a shard and get
    places of their own."""
    out = sharding.shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: SQL can't express the MinHash bands, the entropy balancing or the hashes; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = None
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage stores on its way goes with it; its result stays till the next one stands
            docs = cut(stage(spark, docs, sf_dir), outer=True)
        if stored is not None:
            drop_cut(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
