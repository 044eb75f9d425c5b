from pyspark.sql import functions as F

import corpus_pipeline
from lernwerk.llm import registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns, name
        assert after.count() <= docs.count()
        docs = after
    assert 0.5 < docs.count() / spark.read.parquet(f"{SF}/documents.parquet").count() < 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_registered_queries_return_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op3_source_mixing", "op7_language_id", "op9_pii"):
        assert registry.QUERIES[name](spark, SF).count() == n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = registry.op7_language_id(spark, sf).filter("held_out").join(docs.filter("lang IS NOT NULL"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = registry.op1_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert toxic.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.95
