"""The corpus pipeline: each stage reads what the stage before it kept, and its decisions take effect.

Defined cases: a null text or one without letters has no language and goes in the first stage; rows that
repeat an id or a text stand until near-duplicates keep one of each group; a null id stays a row like others; an
empty table gives no rows; other columns of documents pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import langid, packing, simhash, toxicity
from lectern.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; the models learn from the stage's own input."""
    return docs.where(langid.accepted(docs, langid.train(docs)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(toxicity.clean(docs, toxicity.train(docs, labels)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id is lowest."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, capacity=2048)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", pack)]
#: Tokenizers, learned models and packing are beyond SQL; tests compare the rows with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
