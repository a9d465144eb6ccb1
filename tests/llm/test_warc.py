import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import warc

BIG = "<p>" + "é" * 60 + "</p>"
PAGES = [
    (5, "http://a/\r\nX: 1", BIG), (3, "http://b", BIG), (9, None, BIG), (1, "http://c", None), (2, "http://d", ""), (4, "http://e", "short"),
    (6, "http://f", "short"), (7, "http://g", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9), (8, "http://h", "x" * 3_000_000),
    (10, "http://i", "y" * 99), (11, "http://i", "y" * 99), (12, "http://i", "y" * 100), (13, "http://i", "y" * 100), (14, "u", "z" * 200), (14, "u", "z" * 200), (None, "n", BIG), (None, None, None),
]


def expected():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = i is not None and len(b) >= 100 and first[h] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(pages):
    assert sorted(map(tuple, warc.archived_pages(pages).collect()), key=repr) == expected()


def test_filters_reach_the_reader_and_files_without_commit_are_no_part(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages), path, file_bytes="1000")
    (tmp_path / "archive" / "half.warc.gz").write_bytes(b"broken")
    df = warc.read_warc(spark, path, ["record_id", "warc_type", "http_length"])
    assert df.count() == len(PAGES)
    again = df.filter("warc_type = 'revisit' AND record_id LIKE 'urn:page:%' AND http_length > 0")
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert again.count() == sum(r[3] == "revisit" for r in expected())
    assert plan.count("warc_type") == 0 or "Filter" in plan
    payloads = warc.read_warc(spark, path).filter(F.col("warc_type").isin("response")).select("record_id", "payload", "target_uri").collect()
    assert {r["record_id"]: bytes(r["payload"]) for r in payloads if r["record_id"] == "urn:page:8"}["urn:page:8"] == b"x" * 3_000_000
    assert not any("\n" in (r["target_uri"] or "") for r in payloads)


def test_reader_takes_pushed_tests_and_leaves_others():
    from pyspark.sql import datasource as ds
    from pyspark.sql.types import StructField, StructType, StringType

    reader = warc.WarcReader(StructType([StructField("record_id", StringType())]), {"path": "/tmp"})
    mine, other = ds.EqualTo(("warc_type",), "response"), ds.EqualTo(("payload",), b"x")
    assert list(reader.pushFilters([mine, other])) == [other] and reader.tests == [mine]
    assert warc.header_test(ds.Not(mine))({"warc_type": "revisit"}) and not warc.header_test(ds.Not(mine))({"warc_type": None})


def test_plain_files_of_other_writers(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\nServer: a\r\n b\r\n\r\nbody"
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "one.warc").write_bytes(info + record)
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("warc_type").collect()
    assert [(r["warc_type"], bytes(r["payload"])) for r in rows] == [("response", b"body"), ("warcinfo", b"a: b")]


def test_no_rows(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
