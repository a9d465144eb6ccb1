"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.vectors import best_rows, folded, matrix, one_per_id, ranked
from textloom.session import pin

TREES = 10
# The trees are grown on this many vectors at most; every vector is then put into its leaves.
SAMPLE_ROWS = 20_000
LEAF_ROWS = 128
# Rows that the leaves of a query hold together, over all trees: this share of the table's rows, and this many at least.
SEARCH_SHARE = 0.8
SEARCH_ROWS = 12_000
# Rows of one leaf that a task takes at a time; larger leaves are cut by hash.
BLOCK_ROWS = 4096
# Rows of the leaves that are searched together: a query's best of them leave the task, not its best of every leaf.
GROUP_ROWS = 32_768


class Tree:
    """Inner nodes as arrays; a negative child -1 - i is leaf i."""

    def __init__(self, vectors: np.ndarray, leaf: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        normals, limits, children, sizes = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                a, b = vectors[random.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                normal = normal / length if length > 0 else random.standard_normal(len(a)) / len(a) ** 0.5
                at = vectors[rows] @ normal
                limit = float(np.median(at))
                left, right = rows[at < limit], rows[at >= limit]
                if len(left) and len(right):
                    node = len(limits)
                    normals.append(normal)
                    limits.append(limit)
                    children.append([0, 0])
                    children[node] = [grow(left), grow(right)]
                    return node
            sizes.append(len(rows))
            return -len(sizes)

        self.root = grow(np.arange(len(vectors)))
        self.normals = np.array(normals, np.float32).reshape(-1, vectors.shape[1])
        self.limits, self.children, self.sizes = np.array(limits, np.float32), np.array(children, np.int32).reshape(-1, 2), np.array(sizes)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each row, all rows one level at a time."""
        node = np.full(len(vectors), self.root, np.int32)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            side = np.einsum("ij,ij->i", vectors[inner], self.normals[at]) >= self.limits[at]
            node[inner] = self.children[at, side.astype(np.int8)]
        return -1 - node


def search(trees: list[Tree], query: np.ndarray, rows: float, scale: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) in the order of one queue over all trees, until they hold ``rows`` rows.

    A branch waits with the smallest distance to a cut plane that leaving the query's side costs on the way.
    """
    margins = [t.normals @ query - t.limits for t in trees]
    queue = [(0.0, i, t.root) for i, t in enumerate(trees)]
    out, found = [], 0.0
    while queue and found < rows:
        far, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, -1 - node))
            found += trees[i].sizes[-1 - node] * scale
            continue
        margin = float(margins[i][node])
        near, other = (1, 0) if margin >= 0 else (0, 1)
        heapq.heappush(queue, (far, i, int(trees[i].children[node, near])))
        heapq.heappush(queue, (max(far, abs(margin)), i, int(trees[i].children[node, other])))
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def nearest(
    embeddings: DataFrame, query: Column, k: int = 5, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, search_rows: int = SEARCH_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: per query row the k of largest cosine among the rows found.

    ``embeddings(vec_id, embedding)``; ``query`` tells its query rows. The trees are grown on the
    ``sample_rows`` vectors whose ids have the smallest hashes; all vectors are indexed. The found
    leaves of a query are searched whole, and cosines are computed on the given vectors in double precision.
    They hold SEARCH_SHARE of the rows, ``search_rows`` at least: a tree has a few thousand leaves at any
    larger size, so a query sees the same share of them and recall does not fall as the table grows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
    another dimension than the most frequent one; of rows that share a vec_id the smallest vector counts.
    Equal vectors count once in the index and come back as all their ids. An empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), query.alias("is_query"))
    rows = rows.filter(F.exists("v", lambda x: x != 0.0))
    vectors = pin(one_per_id(rows), "vectors")
    distinct = pin(folded(vectors, k + 1), "distinct-vectors")
    sample = distinct.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(sample_rows).select("v").toArrow()
    n, points = distinct.count(), unit(matrix(sample["v"], np.float64)) if sample.num_rows else None
    if points is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = n / len(points)
    budget = max(search_rows, SEARCH_SHARE * n)
    leaf = max(8, int(LEAF_ROWS / scale))
    forest = [Tree(points, leaf, seed) for seed in range(trees)]
    salts = max(1, round(scale * leaf / BLOCK_ROWS))
    groups = max(1, round(trees * n / (GROUP_ROWS * salts)))
    most = k + 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(matrix(batch.column("v"), np.float64))
            for i, tree in enumerate(forest):
                codes = tree.leaves(points).astype(np.int64) * trees + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array((codes % groups).astype(np.int32)), pa.array(codes), batch.column("v"), batch.column("ids")], ["part", "leaf", "v", "ids"]
                )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(matrix(batch.column("v"), np.float64))
            for j, point in enumerate(points):
                codes = np.sort(np.array([at * trees + i for i, at in search(forest, point, budget, scale)], np.int64))
                codes = codes[np.argsort(codes % groups, kind="stable")]
                parts, first = np.unique(codes % groups, return_index=True)
                one = batch.slice(j, 1).take(pa.array([0] * len(parts), pa.int32()))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), pa.array(codes))
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), leaves, one.column("v"), one.column("vec_id")], ["part", "leaves", "q", "query_id"])

    stored = distinct.mapInArrow(index, "part int, leaf long, v array<double>, ids array<long>")
    stored = stored.withColumn("salt", F.pmod(F.col("ids")[0], F.lit(salts)).cast("int"))
    ids = rows.filter("is_query AND vec_id IS NOT NULL").select("vec_id").distinct()
    # A number of partitions is named: few query rows are much work.
    tasks = max(embeddings.sparkSession.sparkContext.defaultParallelism, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = vectors.join(ids, "vec_id", "left_semi").repartition(tasks, F.col("vec_id"))
    visits = asked.select("v", "vec_id").mapInArrow(visit, "part int, leaves array<long>, q array<double>, query_id long")
    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def rank(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "ids", "score"], [pa.int64(), pa.list_(pa.int64()), pa.float64()]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        v, lists, q = matrix(held["v"], np.float64), held["ids"].combine_chunks(), matrix(asked["q"], np.float64)
        size, length = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", q, q))
        wanted = asked["leaves"].combine_chunks()
        who = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy())
        what, where = wanted.flatten().to_numpy(), held["leaf"].to_numpy()
        by_leaf, by_wish = np.argsort(where, kind="stable"), np.argsort(what, kind="stable")
        queries, places, scores = [], [], []
        for code in np.unique(what):
            rows = by_leaf[np.searchsorted(where, code, "left", by_leaf) : np.searchsorted(where, code, "right", by_leaf)]
            asking = who[by_wish[np.searchsorted(what, code, "left", by_wish) : np.searchsorted(what, code, "right", by_wish)]]
            for start in range(0, len(asking) if len(rows) else 0, 512):
                some = asking[start : start + 512]
                at = best_rows(q[some] @ v[rows].T / size[rows], most)
                i, j = np.repeat(some, at.shape[1]), rows[at.ravel()]
                queries.append(i)
                places.append(j)
                # The same sum for a pair wherever it is met, so ties are ties.
                scores.append(np.einsum("ij,ij->i", q[i], v[j]) / (length[i] * size[j]))
        if not queries:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        i, j, score = np.concatenate(queries), np.concatenate(places), np.concatenate(scores)
        first = lists.flatten().to_numpy()[lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()][j]
        # A vector met in several leaves counts once.
        once = np.lexsort((first, i))
        once = once[np.append(True, (np.diff(i[once]) != 0) | (np.diff(first[once]) != 0))]
        order = once[np.lexsort((first[once], -score[once], i[once]))]
        begins = np.flatnonzero(np.append(True, np.diff(i[order]) != 0))
        rank_in = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        kept = order[rank_in < most]
        columns = [asked["query_id"].combine_chunks().take(pa.array(i[kept])), lists.take(pa.array(j[kept])), pa.array(score[kept])]
        return pa.table(columns, names=names)

    keys = ["part", "salt"]
    hits = visits.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(rank, "query_id long, ids array<long>, score double")
    # A vector beyond the first k + 1, copies folded, is behind k others at every id: only these are unfolded.
    one = hits.groupBy("query_id", F.col("ids")[0].alias("first")).agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    best = one.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return ranked(best.select("query_id", "ids", "score"), k)
