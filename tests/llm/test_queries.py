"""Registered queries against their oracles, held-out accuracy, and the pipeline against its stages' definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from quillspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), compare.connect(SF), queries.ORACLE_SQL[name]) == ""


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = queries.op3_mixture(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = queries.op5_segments(spark, sf).join(labels, "doc_id").filter("held_out")
    assert toxic.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    quality = queries.op9_resampling(spark, sf).join(labels, "doc_id").filter(queries.held_out(F.col("doc_id")))
    assert quality.agg(F.avg((F.col("quality") == F.col("selected").cast("int")).cast("int"))).first()[0] > 0.95


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").filter("text = _t").count()
        assert 0 < kept == out.count() <= docs.count(), name
        docs = corpus_pipeline.materialize(out, name)
    assert docs.count() > 0.5 * 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    ours = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert ours == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))
