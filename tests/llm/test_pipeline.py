import corpus_pipeline
from pyspark.sql import functions as F

from textloom.llm.common import without_ids


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.columns
    before = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == first
    assert before > counts[0] > counts[1] == counts[2] < counts[3]
    tokens = docs.agg(F.sum("length")).first()[0]
    assert docs.filter("sequence_id < 1").agg(F.sum("length")).first()[0] == min(1024, tokens)


def test_run_equals_the_stages(spark, sf):
    one = corpus_pipeline.run(spark, sf).agg(F.count("*"), F.sum("ids_crc32")).first()
    two = corpus_pipeline.run(spark, sf).agg(F.count("*"), F.sum("ids_crc32")).first()
    assert one[0] == two[0] > 0


def test_stages_take_edge_rows(spark, sf, edge_rows):
    rows = [(i, t, [None, "en", "xx"][k % 3], [None, "a"][k % 2], len(t) if t else None) for k, (i, t) in enumerate(edge_rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0 if data else docs.count() == 0


def test_without_ids(spark):
    docs = spark.createDataFrame([(i if i % 11 else None, i) for i in range(1000)], "doc_id int, x int")
    gone = spark.createDataFrame([(i,) for i in range(0, 1000, 3)] * 2 + [(None,)], "doc_id long")
    left = {r["x"] for r in without_ids(docs, gone).collect()}
    assert left == {i for i in range(1000) if i % 11 == 0 or i % 3}
