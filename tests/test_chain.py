import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.operators import clean as cl
from textloom.plans.preprocess import PreprocessConfig, preprocess, run_preprocess
from textloom.sources import readers as rd
from textloom.sources import schemas
from textloom.sources import writers as wr
from textloom.streaming.corpus import preprocess_stream

NAMES = ["John Doe", "Jane Smith", "john  doe", "Peter Jones!", "Jane Smith", "JOHN DOE", " ", "Mary-Ann Li", "MaryAnn Li"]


def test_chain_keeps_the_earliest(spark):
    rows = [(i, n, 30 - i % 3) for i, n in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "id int, content string, timestamp int")
    config = PreprocessConfig(min_doc_length=0, extract_entities=False)
    best = {}
    for i, name, ts in rows:
        clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", name).lower().strip(" "))
        if clean and (clean not in best or (ts, i) < best[clean]):
            best[clean] = (ts, i)
    got = {r["content_clean"]: (r["timestamp"], r["id"]) for r in preprocess(df, config).collect()}
    assert got == best


def test_run_publishes_only_full_results(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"Some Text number {i} that is long enough to be kept by the filter") for i in range(20)], "id string, content string")
    docs = docs.withColumn("timestamp", F.current_timestamp())
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    wr.write_corpus(docs, source)
    counts = run_preprocess(spark, source, target, PreprocessConfig())
    assert counts["original"] == 20 and counts["deduped"] == 20 and counts["entities"] == 40
    assert spark.read.parquet(target).count() == 40
    with pytest.raises(ValueError, match="cleaned"):
        run_preprocess(spark, source, str(tmp_path / "none"), PreprocessConfig(min_doc_length=5000))
    assert not (tmp_path / "none").exists()


def test_missing_columns_and_methods(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="content"):
        preprocess(df, PreprocessConfig())
    with pytest.raises(ValueError, match="label"):
        cl.require_columns(df, "text", "label")
    with pytest.raises(ValueError, match="unknown clean method"):
        cl.clean(df, "other", "text")


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "content": "x", "metadata": {"url": "u"}}, {"id": "2"}]))
    rows = rd.read_corpus(spark, str(tmp_path / "a.json"), schemas.DOCUMENT).orderBy("id").collect()
    assert rows[0]["metadata"] == {"url": "u"} and rows[1]["content"] is None
    (tmp_path / "empty.json").write_text("[]")
    assert rd.read_json(spark, str(tmp_path / "empty.json"), schemas.DOCUMENT).columns == ["id", "content", "metadata", "source", "timestamp"]
    (tmp_path / "c.csv").write_text("other,content\n1,hello\n2,\n")
    assert [r["text"] for r in rd.load_corpus_texts(spark, str(tmp_path / "c.csv")).collect()] == ["hello"]
    (tmp_path / "s.json").write_text(json.dumps(["one", "two", ""]))
    assert [r["text"] for r in rd.load_corpus_texts(spark, str(tmp_path / "s.json")).collect()] == ["one", "two"]
    (tmp_path / "o.json").write_text(json.dumps([{"content": "c"}, {"content": "d"}]))
    assert [r["text"] for r in rd.load_corpus_texts(spark, str(tmp_path / "o.json")).collect()] == ["c", "d"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.txt").write_text(" a \n\n\tb\n")
    assert sorted(r["text"] for r in rd.load_corpus_texts(spark, str(tmp_path)).collect()) == ["a", "b"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "t.txt").write_text(" \n")
    with pytest.raises(ValueError, match="no text"):
        rd.load_corpus_texts(spark, str(tmp_path / "none"))


def test_nested_columns_go_to_csv_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "id int, tags array<string>")
    wr.write_corpus(df, str(tmp_path / "x"), "csv")
    assert rd.read_csv(spark, str(tmp_path / "x")).first()["tags"] == '["a","b"]'


def test_schema_violations(spark):
    rows = [(1, '{"a": "x", "n": 1}'), (2, '{"n": "1"}'), (3, '{"a": 1, "n": 1.5}'), (4, '{"a": "x", "n": 2, "b": true}')]
    df = spark.createDataFrame(rows, "id int, j string")
    out = cl.schema_violations(df, "j", ["a"], {"a": "string", "n": "integer", "b": "boolean"})
    got = {(r["id"], r["violation"]) for r in out.collect()}
    assert got == {
        (2, "Missing required field: a"), (2, "Field n must be integer"),
        (3, "Field a must be string"), (3, "Field n must be integer"),
    }


def test_stream_form(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("text", "content")
    docs = docs.withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))
    source = str(tmp_path / "in")
    docs.write.parquet(source)
    stream = spark.readStream.schema(docs.schema).parquet(source)
    config = PreprocessConfig(extract_entities=False)
    query = (
        preprocess_stream(stream, config).writeStream.format("memory").queryName("kept")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = preprocess(docs, PreprocessConfig(extract_entities=False, id_col="doc_id", order=("doc_id",)))
    assert spark.table("kept").select("content_clean").exceptAll(batch.select("content_clean")).count() == 0
    assert spark.table("kept").count() == batch.count()
