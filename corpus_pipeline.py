"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark passage go, sources are
mixed to target weights (a document's second epoch is a row of its own), and the mix is written as binary shards of token
ids, whose documents the last stage returns. Rows without text pass the first three stages and are no part of a mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import decontamination, mixing, neardup, tokens, toxicity
from lodeworks.llm.scratch import settled

TOXIC_FROM = 0.3
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.passing(docs, lexicon, TOXIC_FROM)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs, n=5, threshold=0.8)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plan = mixing.mix(docs, lambda i: SOURCE_WEIGHTS[i % len(SOURCE_WEIGHTS)])
    return mixing.mixed_texts(docs, plan)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    shards = tokens.write_shards(docs, path, END_ID)
    return tokens.crc32_of(tokens.read_documents(spark, shards)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxic_out), ("near_dedup", copies_out), ("decontamination", leaks_out), ("mixing", mixed), ("tokens", token_ids)]
ORACLE_SQL = None  # tokenizing can't be written in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
