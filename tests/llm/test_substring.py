import hashlib
import random
import re

import pytest

from textloom.llm import substring


def brute(rows, window=50):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_brute_force_on_edge_rows(edge_docs, edge_rows):
    assert got(substring.without_repeats(edge_docs)) == brute(edge_rows)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_on_mosaics(spark, seed):
    """Texts put together from pieces of a few sources, so that factors begin and end everywhere."""
    rng = random.Random(seed)
    sources = [[f"s{k}_{rng.randrange(30 if k == 0 else 9999)}" for _ in range(400)] for k in range(4)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(1, 6)):
            s = rng.choice(sources)
            at = rng.randrange(0, 350)
            words += s[at : at + rng.randrange(5, 120)]
            words += [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 4))]
        rows.append((rng.randrange(50), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring.without_repeats(docs)) == brute(rows)


def test_factors_are_greedy():
    assert substring.factors([]) == []
    assert substring.factors([(0, 30), (0, 60), (10, 90), (20, 40), (85, 95), (200, 260)]) == [(0, 60), (10, 90), (85, 95), (200, 260)]
    assert substring.factors([(5, 9), (5, 9), (9, 12)]) == [(5, 9), (9, 12)]


def test_a_copied_passage_is_one_factor_and_few_windows(spark):
    """Only the first holder's windows and those at the ends of a factor are compared by hash."""
    words = [f"q{i}" for i in range(600)]
    docs = [(i, " ".join([f"a{i}"] * 3 + words + [f"z{i}"] * 3)) for i in range(1, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tables = {}
    pin = substring.pin

    def keeping(frame, name, *args, **kwargs):
        tables[name] = pin(frame, name, *args, **kwargs)
        return tables[name]

    substring.pin = keeping
    try:
        assert got(substring.without_repeats(df)) == brute(docs)
    finally:
        substring.pin = pin
    found = tables["factors"].collect()
    assert sorted((r["doc_id"], r["start"], r["stop"]) for r in found if r["key"] is None) == [(i, 3, 603) for i in range(2, 6)]
    windows = [r["doc_id"] for r in found if r["key"] is not None]
    assert windows.count(1) > 500 and all(windows.count(i) <= 6 for i in range(2, 6))


def test_kept_text(spark):
    words = [f"q{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a " + " ".join(words) + " z")], "doc_id long, text string")
    out = {r["doc_id"]: r["kept_text"] for r in substring.without_repeats(docs, texts=True).collect()}
    assert out[2] == "a z"


def test_no_rows(no_docs):
    assert substring.without_repeats(no_docs).collect() == []
