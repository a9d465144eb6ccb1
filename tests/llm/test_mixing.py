import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Share by weight, cut what exceeds, share the excess again, until nothing exceeds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total, over = sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * w[s] / total
        for s in list(open_):
            if target[s] > most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_sharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 10_000, 123_456]) for i in range(11)} | {None: 77, "é": 50, "Z": 3}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_of_edge_rows(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", None])) for i in range(4000)]
    rows += [(5000, None, "a"), (5001, "", "empty"), (None, "x y", "b"), (7, "again", "c"), (7, "again", "c")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, size int, n int, target string")
    mix = mixing.mixed(docs)
    out = mix.collect()
    assert len(out) == len(rows) and out[0].asDict().keys() >= {"doc_id", "text", "source", "size", "target", "copies"}
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=repr)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    for source in sizes:
        mine = [r for r in out if r["source"] == source]
        assert all(r["copies"] <= 2 and r["source_size"] == sizes[source] for r in mine)
        taken = sum(r["size"] * r["copies"] for r in mine)
        assert mine[0]["target"] == pytest.approx(want[source])
        assert abs(taken - want[source]) <= 0.05 * max(want[source], 200)
    repeated = mixing.repeated(mix, ["doc_id", "text"])
    assert repeated.count() == sum(r["copies"] for r in out)


def test_larger_source_tables_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHIPPED_SOURCES", 1)
    docs = spark.createDataFrame([(i, "a b", f"s{i % 5}" if i % 7 else None) for i in range(100)], "doc_id long, text string, source string")
    few = mixing.mixed(docs).agg(F.sum("copies")).first()[0]
    monkeypatch.setattr(mixing, "SHIPPED_SOURCES", 100)
    assert few == mixing.mixed(docs).agg(F.sum("copies")).first()[0]


def test_no_rows(no_docs):
    assert mixing.mixed(no_docs).collect() == []
