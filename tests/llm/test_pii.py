import hashlib
import re

import pytest
from pyspark.sql import functions as F

from textloom.llm import pii, textspans

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IBAN = "DE89 3704 0044 0532 0130 00"
TEXTS = [
    None, "", "no data here", "mail a.b@c.de, x@y, a@b.c_d@e.f.g and _@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3 9.9.9.9x",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111", "+1 (132) 555-1352. +49 30 1234567890123 +12 +1--2 ++44 20 7946 0958",
    "é\U0001f600 a@b.cd \U0001f600 10.0.0.1 é", "pay to " + IBAN + " now", "pay to DE88 3704 0044 0532 0130 00 now", "xGB82WEST12345698765432 GB82WEST12345698765432",
    "ssn: 123-45-6789, code 123-45-6789", "born 1970-01-31. built 1970-01-31 or, far behind, again", "passport AB1234567 was issued by the office of that town; of a test order the id was 1234567, passport",
    "a@b.c " * 300, "1.2.3.4 4111111111111111 " * 90, "a" * 5000 + "@" + "b" * 5000, "1" * 5000 + ".2.3.4", "+1" + " " * 5000, "visa 4111 1111 1111 1111, example 4111 1111 1111 1111",
]


def luhn(found):
    digits = [int(c) for c in reversed(found) if c.isdigit()]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


KEEP = {
    "email": lambda f: True,
    "ip": lambda f: all(int(p) <= 255 for p in f.split(".")) if max(map(len, f.split("."))) < 1000 else False,
    "card": luhn,
    "phone": lambda f: 10 <= sum(c.isdigit() for c in f) <= 15,
}


def brute(text):
    found = [(m.start(), list(BASE).index(k), k, m.end()) for k, rx in BASE.items() for m in re.finditer(rx, text or "") if KEEP[k](m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def spans(text):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in text.split(","))] if text else []


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [*enumerate(TEXTS), (None, "x@y.z"), (3, TEXTS[3])]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, found string, kind int")
    return rows, pii.scan(docs).collect()


def test_base_spans_equal_brute_force(scanned):
    rows, out = scanned
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    for i, text in rows:
        r, want = by_id[i], brute(text)
        assert [s for s in spans(r["spans"]) if s[0] in BASE] == want
        assert [r[f"n_{k}"] for k in BASE] == [sum(k == n for k, _, _ in want) for n in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()


def test_checksums_and_near_words_decide_on_added_spans(scanned):
    _, out = scanned
    added = {r["doc_id"]: [(k, TEXTS[r["doc_id"]][s:e]) for k, s, e in spans(r["spans"]) if k not in BASE] for r in out if r["doc_id"] is not None}
    assert added[8] == [("iban", IBAN)] and added[9] == []
    assert added[10] == [("iban", "GB82WEST12345698765432")]
    assert added[11] == [("ssn", "123-45-6789"), ("ssn", "123-45-6789")]
    assert added[12] == [("birthdate", "1970-01-31"), ("birthdate", "1970-01-31")]
    assert added[13] == [("idnumber", "AB1234567")]
    assert all(not added[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 14, 15, 16, 17, 18))
    scores = {r["doc_id"]: [int(x) for x in r["scores"].split(",")] for r in out if r["scores"]}
    assert scores[19] == [85, 85]


def test_ordinary_texts_get_no_added_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in pii.scan(docs).collect():
        assert all(k in BASE for k, _, _ in spans(r["spans"]))


def test_plain_columns_only(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(no_docs):
    assert pii.scan(no_docs).collect() == []


def test_running_folds_and_cuts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(9000))
    for n in (0, 1, 63, 64, 65, 5000):
        row = spark.range(1).select(textspans.running(F.sequence(F.lit(1), F.lit(n)) if n else F.expr("cast(array() as array<int>)"), lambda a, b: a + b, F.lit(0)).alias("x")).first()
        assert row["x"] == [i * (i + 1) // 2 for i in range(n)]
    docs = spark.createDataFrame([(text, a, b) for a, b in ((0, 5), (2040, 2060), (4096, 8999), (10, 10), (8990, 9000))], "text string, a int, b int")
    for r in docs.select("a", "b", textspans.let(textspans.pieces(F.col("text")), lambda p: textspans.cut(p, F.col("a"), F.col("b"))).alias("x")).collect():
        assert r["x"] == text[r["a"] : r["b"]]
