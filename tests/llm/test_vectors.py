import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import rpforest, topk

SCHEMA = "vec_id long, embedding array<float>, score int, ids int"
def query():
    return F.col("vec_id") % 50 == 0



def edge_vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)] + [(500 + i, [2.0] * 8) for i in range(3)]
    rows += [(600, None), (601, []), (602, [None] + [1.0] * 7), (603, [math.nan] * 8), (650, [math.inf] * 8), (604, [1.0, 2.0]), (700, [0.0] * 8), (None, [1.0] * 8)]
    rows += [(100, rows[100][1]), (701, rows[3][1]), (701, rows[3][1])]
    return rows


def usable(rows, zero):
    out = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, np.float32).astype(float)
    return out


def brute(vectors, score, k=5):
    out = set()
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted(((-score(vectors[q], v), i) for i, v in vectors.items() if i != q))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA).repartition(3)


def test_exact_products_equal_brute_force(spark):
    rows = edge_vectors()
    whole = {i: np.floor(256 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    got = {tuple(r) for r in topk.top_products(frame(spark, rows), query()).collect()}
    assert got == brute(whole, lambda a, b: int(a @ b))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_few_rows_give_all(spark, n):
    rows = edge_vectors()[:n]
    assert topk.top_products(frame(spark, rows), query()).count() == n - 1
    assert rpforest.nearest(frame(spark, rows), query()).count() == n - 1


def test_bound_order_stops_early_and_loses_nothing():
    rng = np.random.default_rng(0)
    centres = rng.integers(-3000, 3000, (20, 16))
    v = centres[rng.integers(0, 20, 4000)] + rng.integers(-50, 50, (4000, 16))
    q = v[:50]
    pivots = topk.far_points(v.astype(float), 16)
    i, j = topk.best(q, topk.distances(q.astype(float), pivots), v, topk.distances(v.astype(float), pivots), 6)
    for row in range(50):
        scores = v @ q[row]
        want = np.sort(scores)[-6:]
        assert sorted(scores[j[i == row]])[-6:] == want.tolist()


def test_forest_with_all_rows_searched_equals_brute_force(spark):
    rows = edge_vectors()
    vectors = usable(rows, False)
    got = rpforest.nearest(frame(spark, rows), query()).collect()
    want = brute(vectors, lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b)))
    # Parallel vectors tie up to rounding.
    assert {(r[0], r[1]) for r in got} == {(x[0], x[1]) for x in want}
    by = {(q, r): s for q, r, _, s in want}
    for q, r, i, s in map(tuple, got):
        assert s == pytest.approx(by[q, r], abs=1e-12)
        assert s == pytest.approx(vectors[q] @ vectors[i] / math.sqrt((vectors[q] @ vectors[q]) * (vectors[i] @ vectors[i])), abs=1e-12)


def clustered(n, size=64, seed=3):
    """Unit vectors around centres, some of them far more crowded than others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, size))
    v = centres[np.minimum(rng.geometric(0.06, n), 60) - 1] + 0.8 * rng.normal(size=(n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def recall(spark, ids, v, every):
    queries = np.flatnonzero(ids % every == 0)
    scores = v[queries] @ v.T
    scores[np.arange(len(queries)), queries] = -2
    want = {(int(ids[q]), int(ids[c])) for q, s in zip(queries, scores) for c in np.argsort(-s, kind="stable")[:5]}
    table = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": list(v)})).repartition(8)
    got = {(r["query_id"], r["vec_id"]) for r in rpforest.nearest(table, F.col("vec_id") % every == 0).collect()}
    assert len(got) == len(want)
    return len(got & want) / len(want)


def test_forest_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    v = np.stack(rows["embedding"].to_numpy()).astype(float)
    assert recall(spark, rows["vec_id"].to_numpy(), v / np.linalg.norm(v, axis=1, keepdims=True), 50) >= 0.95


@pytest.mark.parametrize(("n", "every"), [(10_000, 100), (40_000, 500)])
def test_forest_recall_does_not_fall_with_size(spark, n, every):
    assert recall(spark, np.arange(n), clustered(n), every) >= 0.95


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_products(none, query()).collect() == [] and rpforest.nearest(none, query()).collect() == []
