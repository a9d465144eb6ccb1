"""Helpers of the two vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(column: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True))


def one_per_id(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the usable vectors that have the most frequent dimension; of rows that share an id the smallest vector."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.filter(F.size("v") == F.lit(common)).groupBy("vec_id").agg(F.min("v").alias("v"))


def folded(rows: DataFrame, ids: int) -> DataFrame:
    """(v, ids): each different vector once, with the ``ids`` smallest of its vec_ids.

    Equal vectors tie at every query and ties go to the smaller vec_id, so no result can need more of
    them. The row limit per vector applies before the shuffle: copies in any number are cheap.
    """
    key = F.xxhash64("v")
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows.withColumn("h", key).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ids)
    return first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1) if n else np.empty((0, 0), dtype)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row of ``scores`` the columns of its k largest values (all, if fewer), in any order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (scores.shape[0], 1))
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from ``hits(query_id, ids, score)``: k per query, ties to the smaller vec_id."""
    one = hits.groupBy("query_id", F.col("ids")[0].alias("first")).agg(F.any_value("ids").alias("ids"), F.max("score").alias("score"))
    rows = one.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
