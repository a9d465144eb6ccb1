import re

import pytest

from textloom.llm import licenses

PHRASES = licenses.PHRASES


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, least=0.8):
    w = words(text)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, share = {x for _, x in hits}, 0.0
    for paragraph in re.split(r"\n[ \t\r]*\n", text or ""):
        for block in [*paragraph.split("\n"), paragraph]:
            b = set(words(block))
            for label, template in licenses.TEMPLATES.items():
                t = set(words(template))
                if len(b & t) >= least * len(t) - 1e-9:
                    labels.add(label)
                    share = max(share, len(b & t) / len(t))
    places = [i for i, _ in hits]
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), pytest.approx(1.0 if hits else share))


TEXTS = [
    None, "", "\n\n", "no notice", "The MIT License, the Mit-license and MIT\nLICENSE", "an Apache é License", "apache license apache license",
    licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["mit-text"].replace(" ", "\n"), licenses.TEMPLATES["bsd-text"][:60],
    "x\n" + licenses.TEMPLATES["gpl-notice"] + " and more words\ny", "Licensed under CC BY-NC 4.0.\nrest", "licensed cc by 4 0 under",
    "All rights\n \nreserved", "All rights\nreserved", "the general public license " * 3000, " ".join(licenses.TEMPLATES.values()), "reserved all rights x y z",
]


def test_equals_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, TEXTS[7])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, base string").repartition(3)
    got = {(r[0], r["n_words"]): tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert licenses.scan(docs).count() == len(rows)
    for i, t in rows:
        want = brute(t)
        assert got[i, want[0]] == want


def test_any_threshold_finds_all(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for least in (0.5, 1.0):
        got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs, least=least).collect()}
        assert got == {i: brute(t, least)[5] for i, t in enumerate(TEXTS)}


def test_no_rows(no_docs):
    assert licenses.scan(no_docs).collect() == []
