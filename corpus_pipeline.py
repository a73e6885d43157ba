"""The corpus pipeline: bad and toxic documents and near-duplicates out, sources mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import mixing, packing, quality, simhash, tokens, toxicity
from pixelweave.llm.common import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES = [("quality", good), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the models, fingerprints and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the table between two stages is written to the shared folder, so none is run twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
