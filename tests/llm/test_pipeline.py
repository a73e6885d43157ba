"""The pipeline's stages on their own inputs, and as a whole."""

import corpus_pipeline
from pyspark.sql import functions as F

from pixelweave.llm import tokens


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    left = lambda name, label, value: seen[name].join(labels.where(F.col(label) == value), "doc_id").count()
    assert left("quality", "quality", 0) == 0 and left("quality", "quality", 1) >= 0.99 * labels.where("quality = 1").count()
    assert left("toxicity", "toxic", 1) <= 0.1 * labels.where("toxic = 1").count()
    kept = seen["near_duplicates"]
    assert kept.select("text").distinct().count() == kept.count() == kept.select("doc_id").distinct().count()
    mixed = seen["mixing"]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    packed = seen["packing"]
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.agg(F.sum("length")).first()[0] == mixed.count() + tokens.token_counts(mixed, tokens.vocabulary()).agg(F.sum("n_tokens")).first()[0]


def test_stages_take_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
