"""Exact top-k by integer inner product, with a table of pivot distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.vectors import folded, matrix, one_per_id, ranked
from textloom.session import pin

PIVOTS = 32
# Pivots are chosen among this many vectors at most.
SAMPLE_ROWS = 5_000
BLOCK_ROWS = 8192
SLACK = 1e-6


def far_points(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    chosen, near = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def most_possible(square_q: np.ndarray, square_v: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Upper bound of the inner product of points that are ``apart`` at least."""
    bound = (square_q[:, None] + square_v[None] - apart**2) / 2
    return bound + SLACK * (1 + np.abs(bound))


def best(q: np.ndarray, q_far: np.ndarray, v: np.ndarray, v_far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query, rows of its k largest products and ties of the last (flat pairs of indexes).

    Each pair's largest lower bound of the distance over all pivots bounds its product. Candidates are
    evaluated in bound order, twice as many at a time, until no bound left reaches the k-th product.
    """
    apart = np.zeros((len(q), len(v)))
    for p in range(q_far.shape[1]):
        np.maximum(apart, np.abs(q_far[:, p][:, None] - v_far[:, p][None]), out=apart)
    bound = most_possible((q.astype(float) ** 2).sum(axis=1), (v.astype(float) ** 2).sum(axis=1), apart)
    rows, columns = [], []
    for i in range(len(q)):
        order, done, last = np.argsort(-bound[i], kind="stable"), 0, -np.inf
        scores = np.empty(len(v), np.int64)
        while done < len(v) and bound[i, order[done]] >= last:
            step = order[done : 2 * done + 64]
            scores[done : done + len(step)] = v[step] @ q[i]
            done += len(step)
            if done >= k:
                last = np.partition(scores[:done], done - k)[done - k]
        kept = np.flatnonzero(scores[:done] >= last)
        rows.append(np.full(len(kept), i))
        columns.append(order[kept])
    return np.concatenate(rows), np.concatenate(columns)


def top_products(embeddings: DataFrame, query: Column, k: int = 5, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product of floor(scale * x), exactly.

    ``embeddings(vec_id, embedding)``; ``query`` tells its query rows. (1) Every vector stores its
    distances to the pivots and goes to the cell of its nearest pivot; cells are cut by hash into
    blocks. (2) Each query meets one block of its most promising cell: its k-th product there is a floor.
    (3) It then visits the cells whose bound reaches the floor, block by block. Rows are never copied; a
    query is sent once per block that could hold a result.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do those of
    another dimension than the most frequent one; of rows that share a vec_id the smallest vector counts.
    Equal vectors are evaluated once and come back as all their ids. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), query.alias("is_query"))
    whole = pin(one_per_id(rows).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")), "vectors")
    distinct = folded(whole, k + 1)
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    points = far_points(np.unique(matrix(sample["v"], np.float64), axis=0), pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), np.float64)
            far = distances(v, points)
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids"), batch.column("v"), pa.array(list(far), pa.list_(pa.float64())), pa.array(far.argmin(axis=1), pa.int32()), pa.array((v**2).sum(axis=1))],
                ["ids", "v", "far", "cell", "square"],
            )

    stored = pin(distinct.mapInArrow(place, "ids array<long>, v array<long>, far array<double>, cell int, square double"), "pivot-table")
    limits = [f(F.col("far")[p]).alias(f"{n}{p}") for p in range(len(points)) for n, f in (("min", F.min), ("max", F.max))]
    cells = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square"), *limits).toPandas()  # a row per pivot
    low, high = (cells[[f"{n}{p}" for p in range(len(points))]].to_numpy() for n in ("min", "max"))
    number, square = cells["cell"].to_numpy(), cells["square"].to_numpy()
    blocks = np.maximum(1, np.ceil(cells["n"].to_numpy() / BLOCK_ROWS)).astype(int)
    salts = F.array(*[F.lit(int(blocks[list(number).index(c)]) if c in number else 1) for c in range(len(points))])
    stored = stored.withColumn("salt", F.pmod(F.col("ids")[0], F.get(salts, F.col("cell"))).cast("int"))

    def visits(asked: DataFrame, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("q"), np.float64)
                far = distances(q, points)
                apart = np.maximum(0, np.maximum(low[None] - far[:, None], far[:, None] - high[None]).max(axis=2))
                bound = most_possible((q**2).sum(axis=1), square, apart)
                if first:
                    i, j = np.arange(len(q)), bound.argmax(axis=1)
                    salt = np.zeros(len(q), int)
                else:
                    i, j = np.nonzero(bound >= batch.column("least").to_numpy(zero_copy_only=False)[:, None])
                    i, j, salt = np.repeat(i, blocks[j]), np.repeat(j, blocks[j]), np.concatenate([np.arange(b) for b in blocks[j]] or [np.empty(0, int)])
                one = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays(
                    [one.column("query_id"), one.column("q"), pa.array(list(far[i]), pa.list_(pa.float64())), pa.array(number[j], pa.int32()), pa.array(salt, pa.int32())],
                    ["query_id", "q", "q_far", "cell", "salt"],
                )

        return asked.mapInArrow(run, "query_id long, q array<long>, q_far array<double>, cell int, salt int")

    def met(asked: DataFrame, held: DataFrame) -> DataFrame:
        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            names, kinds = ["query_id", "ids", "score"], [pa.int64(), pa.list_(pa.int64()), pa.int64()]
            if not asked.num_rows or not held.num_rows:
                return pa.table([pa.array([], t) for t in kinds], names=names)
            v, v_far, lists, out = matrix(held["v"], np.int64), matrix(held["far"], np.float64), held["ids"].combine_chunks(), []
            for start in range(0, asked.num_rows, 256):
                some = asked.slice(start, 256)
                q = matrix(some["q"], np.int64)
                i, j = best(q, matrix(some["q_far"], np.float64), v, v_far, k + 1)
                score = np.einsum("ij,ij->i", q[i], v[j])
                # Ties of the last place: the smallest ids, k + 1 of them, are enough.
                order = np.lexsort((np.array([x[0].as_py() for x in lists.take(pa.array(j))]), -score, i))
                i, j, score = i[order], j[order], score[order]
                kept = np.arange(len(i)) - np.searchsorted(i, i) <= k
                out.append(pa.table([some["query_id"].combine_chunks().take(pa.array(i[kept])), lists.take(pa.array(j[kept])), pa.array(score[kept])], names=names))
            return pa.concat_tables(out)

        keys = ["cell", "salt"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "query_id long, ids array<long>, score long")

    ids = rows.filter("is_query AND vec_id IS NOT NULL").select("vec_id").distinct()
    asked = pin(whole.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    opening = met(visits(asked, True), stored.filter("salt = 0"))
    # Of k + 1 different vectors one can be the query itself: the k-th of the others is a floor.
    floor = ranked(opening, k).filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
    asked = asked.join(pin(floor, "floors"), "query_id", "left").fillna(-1e300, ["least"])
    return ranked(met(visits(asked, False), stored), k)
