"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; every stage but the
last returns the columns of documents. A stage's result is written as Parquet and read again as the next
one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import common, mixing, packing, quality, simhash, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models predict toxic go."""
    return toxicity.score(docs, _labels(spark, sf_dir)).filter("predicted = 0").select("doc.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score under the threshold go."""
    return quality.judge(docs, _labels(spark, sf_dir)).filter("kept").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles one stays."""
    return simhash.near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix of the sources takes it."""
    return mixing.mix(docs).select(F.explode(F.expr("array_repeat(doc, copies)")).alias("doc")).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, and the sequence and place that each goes to."""
    packed = packing.pack(packing.cut(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.withColumn("ids_crc32", F.crc32("ids")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' models have no form in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
