"""CSV rows and JSON elements that lines do not bound, read in byte ranges of any size."""

import csv
import json
import random

import pytest

from textloom.sources import readers, records


@pytest.fixture(params=["300b", "128m"])
def ranged(request, spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_csv_rows_with_line_breaks_in_quotes(ranged, tmp_path):
    rng = random.Random(1)
    value = lambda: rng.choice(["plain", "", 'say "hi"', "two\nlines", "comma, here", '5" pipe', 'a\n\n"b",\n' + "x" * 90, "é\n\U0001f600", '"'])
    want = []
    for f in range(3):
        rows = [(str(f * 1000 + i), value(), value()) for i in range(60)]
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            w = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]) if f else "\n")
            w.writerow(["id", "text", "label"])
            w.writerows(rows)
        want += rows
    got = readers.read_csv(ranged, str(tmp_path), infer=False).collect()
    assert sorted((r["id"], r["text"] or "", r["label"] or "") for r in got) == sorted(want)
    assert dict(readers.read_csv(ranged, str(tmp_path)).dtypes)["id"] == "int"


def test_csv_probes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"line one\nline two",pos\n5" pipe,neg\n\nlast,pos')
    rows = readers.read_task_csv(spark, str(tmp_path / "a.csv"), "classification").collect()
    assert [tuple(r) for r in rows] == [("line one\nline two", "pos"), ('5" pipe', "neg"), ("last", "pos")]
    (tmp_path / "b.csv").write_text('text,label\n"open,pos\n')
    with pytest.raises(ValueError, match="inside quotes"):
        readers.read_csv(spark, str(tmp_path / "b.csv"))


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(ranged, tmp_path, indent):
    rng = random.Random(2)
    text = lambda: rng.choice(["", "a, b", 'q " [ { ] }', "back\\slash\\", "}],[{", "é\U0001f600\n", "x" * 120])
    want = []
    for f in range(3):
        rows = [{"id": f * 1000 + i, "text": text(), "tags": [text(), {"k": [1, 2]}]} for i in range(50 if f else 1)]
        (tmp_path / f"{f}.json").write_text(json.dumps(rows, indent=indent), encoding="utf-8")
        want += [(r["id"], r["text"], r["tags"][0]) for r in rows]
    got = readers.read_json(ranged, str(tmp_path), "id long, text string, tags array<string>").collect()
    assert sorted((r["id"], r["text"], r["tags"][0]) for r in got) == sorted(want)
    assert set(readers.read_json(ranged, str(tmp_path)).columns) == {"id", "tags", "text"}


def test_json_texts_and_broken_files(ranged, tmp_path):
    for name, value in (("a", ["one, two", "three", "", 'qu"o]te']), ("b", [{"text": "x, y"}, {"content": "z"}, {"text": None}]), ("e", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    texts = lambda n: sorted(r["text"] for r in readers.load_corpus_texts(ranged, str(tmp_path / f"{n}.json")).collect())
    assert texts("a") == ["one, two", 'qu"o]te', "three"]
    assert {"x, y", "z"} <= set(texts("b"))
    with pytest.raises(ValueError, match="no text"):
        texts("e")
    (tmp_path / "c.json").write_text('[{"text": "one"}, {"text": "tw')
    for read in (readers.load_corpus_texts, readers.read_json):
        with pytest.raises(ValueError, match="inside a string"):
            read(ranged, str(tmp_path / "c.json"))
    assert readers.read_json(ranged, str(tmp_path / "e.json"), "text string").collect() == []


def test_large_files_take_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"i": i, "text": "x, " * 20} for i in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = readers.read_json(spark, str(tmp_path / "a.json"), "i long, text string")
        assert rows.rdd.getNumPartitions() >= 5 and rows.agg({"i": "sum"}).first()[0] == 20_000 * 19_999 // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
